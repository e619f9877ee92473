"""RDF/XML: the forms of the syntax by hand, the same triples as a Turtle text, broken and empty texts."""

from strata.sources import rdfxml, turtle

HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:e="http://e.org/" xml:base="http://e.org/d">'
R = rdfxml.RDF


def raw(body):
    return list(rdfxml.statements(HEAD + body + "</rdf:RDF>"))


def test_nodes_and_properties():
    assert raw('<e:T rdf:about="a" e:p="1"><e:q rdf:resource="#b"/><e:r xml:lang="en"> two &lt; 3 </e:r></e:T>') == [
        ("http://e.org/a", R + "type", "http://e.org/T"), ("http://e.org/a", "http://e.org/p", "1"), ("http://e.org/a", "http://e.org/q", "http://e.org/d#b"), ("http://e.org/a", "http://e.org/r", " two < 3 ")]
    # nested nodes, a base of its own, a nodeID that joins two places, an empty literal
    assert sorted(raw('<rdf:Description rdf:ID="a" xml:base="http://f.org/x"><e:q><e:T rdf:nodeID="n"><e:r/></e:T></e:q></rdf:Description><rdf:Description rdf:nodeID="n" e:p="1"/>')) == [
        ("_:nn", "http://e.org/p", "1"), ("_:nn", "http://e.org/r", ""), ("_:nn", R + "type", "http://e.org/T"), ("http://f.org/x#a", "http://e.org/q", "_:nn")]


def test_parse_types_and_containers():
    assert sorted(raw('<rdf:Bag rdf:about="a"><rdf:li>x</rdf:li><rdf:li rdf:resource="b"/></rdf:Bag>')) == [("http://e.org/a", R + "_1", "x"), ("http://e.org/a", R + "_2", "http://e.org/b"), ("http://e.org/a", R + "type", R + "Bag")]
    assert sorted(raw('<rdf:Description rdf:about="a"><e:q rdf:parseType="Resource"><e:r>1</e:r></e:q></rdf:Description>')) == [("_:b1", "http://e.org/r", "1"), ("http://e.org/a", "http://e.org/q", "_:b1")]
    assert raw('<rdf:Description rdf:about="a"><e:q rdf:parseType="Literal">x<i>y<b/></i>z</e:q></rdf:Description>') == [("http://e.org/a", "http://e.org/q", "x<i>y<b /></i>z")]
    listed = raw('<rdf:Description rdf:about="a"><e:q rdf:parseType="Collection"><rdf:Description rdf:about="b"/><rdf:Description rdf:about="c"/></e:q><e:s rdf:parseType="Collection"/></rdf:Description>')
    assert listed == [("_:b1", R + "first", "http://e.org/b"), ("_:b1", R + "rest", "_:b2"), ("_:b2", R + "first", "http://e.org/c"), ("_:b2", R + "rest", R + "nil"), ("http://e.org/a", "http://e.org/q", "_:b1"), ("http://e.org/a", "http://e.org/s", R + "nil")]
    assert sorted(raw('<rdf:Description rdf:about="a"><e:q e:r="1"/></rdf:Description>')) == [("_:b1", "http://e.org/r", "1"), ("http://e.org/a", "http://e.org/q", "_:b1")]


def test_reified_statements():
    blank = '<rdf:Statement><rdf:object rdf:resource="c"/><rdf:subject rdf:resource="b"/><rdf:predicate rdf:resource="http://e.org/v#uses"/></rdf:Statement><rdf:Statement><rdf:subject rdf:resource="b"/></rdf:Statement>'
    assert list(rdfxml.parse(HEAD + blank + "</rdf:RDF>")) == [("http://e.org/b", "semantic_uses", "http://e.org/c")]
    found = list(rdfxml.parse(HEAD + '<rdf:Description rdf:about="a"><e:q rdf:ID="s" rdf:resource="b"/></rdf:Description></rdf:RDF>'))
    assert found[0] == ("http://e.org/a", "http://e.org/q", "http://e.org/b") and ("http://e.org/a", "semantic_q", "http://e.org/b") in found and len(found) == 6


def test_literals_like_blank_nodes():
    assert list(rdfxml.parse(HEAD + '<rdf:Description rdf:about="a"><e:q>_:b1</e:q><e:q rdf:nodeID="b1"/></rdf:Description></rdf:RDF>')) == [("http://e.org/a", "http://e.org/q", "_:b1")]


def test_same_triples_as_turtle(spark):
    body = '<rdf:Description rdf:about="http://e.org/a"><rdf:type rdf:resource="http://e.org/T"/><e:p>x "y"</e:p><e:q rdf:resource="http://e.org/b"/></rdf:Description>'
    text = '<http://e.org/a> a <http://e.org/T> ; <http://e.org/p> "x \\"y\\"" ; <http://e.org/q> <http://e.org/b> .'
    files = spark.createDataFrame([(HEAD + body + "</rdf:RDF>", text)], "xml string, ttl string")
    assert sorted(map(tuple, rdfxml.triples(files, "xml").collect())) == sorted(map(tuple, turtle.triples(files, "ttl").collect())) != []


def test_broken_and_odd_texts(spark):
    whole = HEAD + '<rdf:Description rdf:about="a" e:p="1"/>'
    texts = spark.createDataFrame([(None,), ("",), ("no xml",), (whole + "<e:T",), ('<?xml version="1.0" encoding="latin-1"?>' + HEAD + '<e:T rdf:about="é"/></rdf:RDF>',)], "text string")
    assert sorted(map(tuple, rdfxml.triples(texts).collect())) == [("http://e.org/a", "http://e.org/p", "1"), ("http://e.org/é", "rdf:type", "http://e.org/T")]
    assert rdfxml.triples(texts.limit(0)).collect() == []
    deep = HEAD + '<e:T rdf:about="a"><e:q>' * 5000 + "</e:q></e:T>" * 5000 + "</rdf:RDF>"
    assert len(list(rdfxml.statements(deep))) == 10000
    long = HEAD + f'<rdf:Description rdf:about="a"><e:p>{"x" * 300_000}</e:p></rdf:Description></rdf:RDF>'
    assert [len(o) for _, _, o in rdfxml.statements(long)] == [300_000]
