"""Inputs that Spark derives from the given tables: code entities from parts, references from line items, axioms from the geography.

Each is one SELECT that Spark and DuckDB read alike; the names of tables stand in braces. The SQL side of a query gets the same
SELECT as a common table expression, so both sides grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.plans.registry import table

_NAME = "concat(replace({0}p_name, ' ', '_'), '_', CAST({0}p_partkey AS STRING))"
_KIND = "CASE WHEN {0}p_partkey % 211 = 5 THEN 'program' WHEN {0}p_partkey % 7 = 0 THEN 'module' WHEN {0}p_partkey % 7 < 4 THEN 'subroutine' WHEN {0}p_partkey % 7 < 6 THEN 'function' ELSE 'type_definition' END"
_GROUP = "CAST(floor({0}p_partkey / 64) AS INT)"
#: lines of one order that follow each other
_FOLLOW = "FROM {lineitem} a JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN {part} p ON p.p_partkey = b.l_partkey"
_TO = f"CASE WHEN b.l_suppkey % 6 = 0 THEN concat('ext_', CAST(b.l_suppkey AS STRING)) WHEN b.l_linenumber % 2 = 0 THEN upper({_NAME.format('p.')}) ELSE {_NAME.format('p.')} END"
_LINE = "CAST(a.l_linenumber + 10 * (a.l_orderkey % 50) AS INT)"
_GEO = "FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey"
_NATION, _REGION = "concat(replace(r.r_name, ' ', '_'), '#', n.n_name)", "concat(replace(r.r_name, ' ', '_'), '#region')"

#: a text on one line, in lower case, without stops and commas
_FLAT = "lower(translate(replace(text, chr(10), ' '), '.,', ''))"

DERIVED: dict[str, str] = {
    "entities": f"SELECT CAST(p_partkey AS INT) AS entity_id, {_NAME.format('')} AS name, {_KIND.format('')} AS etype, concat(lower(replace(p_brand, '#', '_')), '_', CAST(CAST(floor(p_partkey / 500) AS INT) AS STRING), '.f90') AS file, "
    f"CAST(1 + (p_partkey * 37) % 900 AS INT) AS start_line, CAST(1 + (p_partkey * 37) % 900 + CASE WHEN p_partkey % 7 = 0 THEN 300 ELSE 2 * p_size END AS INT) AS end_line, CAST(p_size % 50 AS DOUBLE) / 100 + CAST(0.5 AS DOUBLE) AS confidence, p_size % 10 <> 0 AS is_complete, p_partkey % 5 = 0 AS is_grouped, "
    f"CASE WHEN p_partkey % 7 IN (1, 2, 3) THEN concat('subroutine ', {_NAME.format('')}, '(n)') ELSE '' END AS signature FROM {{part}}",
    "uses": f"SELECT CAST(a.l_partkey AS INT) AS src_id, {_TO} AS dst_name, {_LINE} AS line {_FOLLOW} WHERE a.l_quantity >= 41 AND b.l_quantity >= 41",
    "calls": f"SELECT CAST(a.l_partkey AS INT) AS src_id, {_TO} AS dst_name, {_LINE} AS line {_FOLLOW} WHERE a.l_quantity <= 4 AND b.l_quantity <= 4",
    "entity_concepts": f"SELECT CAST(p_partkey AS INT) AS entity_id, concat(split_part(p_name, ' ', 1), '_', CAST({_GROUP.format('')} AS STRING)) AS label, CAST(p_size AS DOUBLE) / 100 AS confidence, 'shape' AS category FROM {{part}} "
    f"UNION ALL SELECT CAST(p_partkey AS INT), concat(split_part(p_name, ' ', 2), '_', CAST({_GROUP.format('')} AS STRING)), CAST(p_size % 40 AS DOUBLE) / 100, 'thing' FROM {{part}} "
    "UNION ALL SELECT CAST(p_partkey AS INT), CASE WHEN p_partkey % 2 = 0 THEN 'grid' ELSE 'solver' END, CAST(0.75 AS DOUBLE), 'structure' FROM {part} WHERE p_partkey % 97 = 3",
    "axioms": f"SELECT 'subsumption' AS type, {_NATION} AS source, {_REGION} AS target {_GEO} UNION SELECT 'subsumption', {_REGION}, 'geo#world' {_GEO} "
    f"UNION SELECT 'subsumption', concat(replace(r.r_name, ' ', '_'), '#', s.s_name), {_NATION} {_GEO} JOIN {{supplier}} s ON s.s_nationkey = n.n_nationkey "
    f"UNION SELECT 'subsumption', concat(replace(r.r_name, ' ', '_'), '#', s.s_name), {_REGION} {_GEO} JOIN {{supplier}} s ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey % 4 = 0 "
    "UNION SELECT 'subsumption', concat('loop#', CAST(r_regionkey AS STRING)), concat('loop#', CAST((r_regionkey + 1) % 5 AS STRING)) FROM {region} "
    "UNION SELECT CASE WHEN n.n_nationkey % 3 = 0 THEN 'semantic_equivalent' WHEN n.n_nationkey % 3 = 1 THEN 'semantic_opposite' ELSE 'semantic_related' END, "
    f"{_NATION}, concat(replace(r.r_name, ' ', '_'), '#', m.n_name) {_GEO} JOIN {{nation}} m ON m.n_nationkey = n.n_nationkey + 5",
    "chunk_concepts": f"SELECT CAST(d.doc_id AS INT) AS chunk_id, {_NATION} AS uri, n.n_name AS label, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence {_GEO} JOIN {{documents}} d ON n.n_nationkey IN (d.doc_id % 25, (d.doc_id * 7 + 3) % 25)",
    "query_concepts": f"SELECT {_NATION} AS uri, n.n_name AS label, CAST(n.n_nationkey AS DOUBLE) / 20 AS confidence {_GEO} WHERE n.n_nationkey IN (3, 16)",
    "triples_detected": "SELECT replace(c_name, '#', ' ') AS sub, 'livesIn' AS rel, concat(n_name, '.') AS obj FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0",
    "triples_gold": "SELECT lower(replace(c_name, '#', '_')) AS sub, 'livesin' AS rel, CASE WHEN c_custkey % 8 = 0 THEN 'nowhere' ELSE concat(n_name, '.') END AS obj FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0",
    "relation_edges": "SELECT DISTINCT concat('s', CAST(a.l_suppkey AS STRING)) AS s, concat('s', CAST(b.l_suppkey AS STRING)) AS o FROM {lineitem} a JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 49 AND b.l_quantity >= 49",
    "asked": f"SELECT CAST(p_partkey AS INT) AS query_id, CASE WHEN p_partkey % 4 = 0 THEN concat('how does ', {_NAME.format('')}, ' fill a module?') WHEN p_partkey % 4 = 1 THEN concat('see doi 10.1000/ABC.', CAST(p_partkey AS STRING), ' on ', upper({_NAME.format('')})) "
    f"WHEN p_partkey % 4 = 2 THEN 'résumé of the introduction section' ELSE concat('the subroutine with a call to ', {_NAME.format('')}) END AS query FROM {{part}} WHERE p_partkey % 13 = 0",
    "targets": f"SELECT CAST(p_partkey AS INT) AS query_id, {_NAME.format('')} AS target FROM {{part}} WHERE p_partkey % 26 = 0 UNION ALL SELECT CAST(p_partkey AS INT), 'Deep' FROM {{part}} WHERE p_partkey % 39 = 0",
    "ranked": f"SELECT CAST(q.p_partkey AS INT) AS query_id, CAST(c.p_partkey AS INT) AS chunk_id, CAST(c.p_partkey - q.p_partkey + 1 AS INT) AS rank, CASE WHEN c.p_partkey % 3 = 0 THEN {_NAME.format('c.')} ELSE concat('chunk_', CAST(c.p_size AS STRING)) END AS name, "
    f"CASE WHEN c.p_partkey % 4 = 0 THEN concat('subroutine ', upper({_NAME.format('c.')}), '(n)') WHEN c.p_partkey % 4 = 1 THEN 'calls deep things' ELSE 'nothing' END AS text, CASE WHEN c.p_partkey % 3 < 2 THEN concat('g', CAST({_GROUP.format('c.')} AS STRING)) END AS part_of FROM {{part}} q JOIN {{part}} c ON c.p_partkey >= q.p_partkey AND c.p_partkey < q.p_partkey + 8 AND floor(c.p_partkey / 13) = floor(q.p_partkey / 13) WHERE q.p_partkey % 13 = 0",
    "sources": f"SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('subroutine s', chr(10), ' do i = 1, n', chr(10), '  call ', {_NAME.format('')}, '(i)', chr(10), ' end do', chr(10), 'end subroutine') "
    "WHEN p_partkey % 3 = 1 THEN concat('!$OMP parallel do', chr(10), ' do i = 1, n', chr(10), '  x = i', chr(10), ' end do', chr(10), ' allocate(a(n))') "
    f"ELSE concat('real function outer(x)', chr(10), ' ! note', chr(10), ' real :: ', {_NAME.format('')}, chr(10), 'contains', chr(10), ' pure function inner(z)', chr(10), '  inner = z', chr(10), ' end function inner', chr(10), 'end function outer') END AS text FROM {{part}}",
    "links": f"SELECT concat(replace(r.r_name, ' ', '_'), '#', s.s_name) AS child, {_REGION} AS parent {_GEO} JOIN {{supplier}} s ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey % 3 = 0 UNION ALL SELECT s_name, s_name FROM {{supplier}} WHERE s_suppkey % 5 = 0",
    "alike": "SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey % 20 AS STRING)) AS name, CAST(l_quantity AS DOUBLE) / 100 AS similarity, CASE WHEN l_linenumber % 3 = 0 THEN 'concepts' ELSE 'name' END AS method, CASE WHEN l_returnflag = 'A' THEN 'shared' WHEN l_returnflag = 'N' THEN 'near' ELSE 'alike' END AS reason FROM {lineitem}",
    "patterned": "SELECT CAST(p_partkey AS INT) AS entity_id, concat(CASE p_partkey % 8 WHEN 0 THEN 'init_grid_cell_' WHEN 1 THEN 'compute_matrix_norm_' WHEN 2 THEN 'read_file_' WHEN 3 THEN 'velocity_integrator_' WHEN 4 THEN 'write_open_' WHEN 5 THEN 'evaluate_' WHEN 6 THEN 'setup_mesh_' ELSE 'plain_' END, CAST(p_partkey AS STRING)) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'subroutine s(domain, vector)' ELSE 'function f(position)' END AS signature FROM {part}",
    "typed": "SELECT CAST(p_partkey AS INT) AS entity_id, concat(CASE p_partkey % 5 WHEN 0 THEN 'Constants_mod_' WHEN 1 THEN 'math_utilities_' WHEN 2 THEN 'total_FORCE_' WHEN 3 THEN 'energy_step_' ELSE 'energy_mod_' END, CAST(p_partkey AS STRING)) AS name, CASE p_partkey % 5 WHEN 2 THEN 'function' WHEN 3 THEN 'subroutine' ELSE 'module' END AS etype FROM {part}",
    "crossing": "SELECT CAST(p_partkey AS INT) AS entity_id, CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'low' END AS local, CAST(p_size % 12 AS INT) AS outgoing, CASE WHEN p_partkey % 2 = 0 THEN 'high' WHEN p_partkey % 6 = 1 THEN 'low' END AS risk, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 4 - 1 AS INT) END AS n FROM {part}",
    "notes": "SELECT doc_id, concat('# Alpha', CAST(doc_id AS STRING), chr(10), 'Intro one. Intro two.', chr(10), '## ', lang, chr(10), '- item', chr(10), '- item two', chr(10), '### ', source, chr(10), 'See [7] and https://example.org/x now.', chr(10), '## Delta', chr(10), 'She said \"short phrase\" here.', chr(10), 'SUMMARY', chr(10), '1.2. Numbered', chr(10), 'End.') AS text FROM {documents}",
    "code": "SELECT concat(CAST(p_partkey AS STRING), '.f90') AS file, concat('subroutine demo', CAST(p_partkey AS STRING), '(x)', chr(10), '  character(4) :: s = ', chr(39), 'a!b', chr(39), ' ! note', chr(10), '!$omp parallel', chr(10), '  call step_', split_part(p_name, ' ', 1), '(x) ! call fake(x)', chr(10), '  y = step_two(x) + step_three(x)', chr(10), 'end subroutine demo', CAST(p_partkey AS STRING)) AS text FROM {part}",
    "phrases": "SELECT conv_id, turn, split_part(text, ' ', 1) AS original, lower(split_part(text, ' ', 2)) AS replacement FROM {conversations} UNION ALL SELECT conv_id, turn, replace(upper(split_part(text, ' ', 1)), 'ẞ', 'SS'), split_part(text, ' ', 2) FROM {conversations}",
    "domain_concepts": "SELECT DISTINCT concat('http://example.org/o#', CASE WHEN p_size % 3 = 0 THEN 'old_' ELSE '' END, lower(p_type), '_', replace(p_name, ' ', '_')) AS uri FROM {part} WHERE p_size % 7 > 2",
    "vocabulary": f"SELECT DISTINCT concat(lang, '#', w) AS uri, w AS label FROM (SELECT lang, split_part({_FLAT}, ' ', 1) AS w FROM {{documents}} UNION ALL SELECT lang, split_part({_FLAT}, ' ', 2) FROM {{documents}}) WHERE w <> '' AND lang IS NOT NULL",
    "word_axioms": f"SELECT 'semantic_related' AS type, concat(lang, '#', split_part({_FLAT}, ' ', 1)) AS source, concat(lang, '#', split_part({_FLAT}, ' ', 2)) AS target FROM {{documents}} WHERE lang IS NOT NULL AND text IS NOT NULL "
    f"UNION SELECT 'subsumption', concat(lang, '#', split_part({_FLAT}, ' ', 1)), concat('letter#', substr({_FLAT}, 1, 1)) FROM {{documents}} WHERE lang IS NOT NULL AND text IS NOT NULL",
    "domain_names": "SELECT DISTINCT lower(p_type) AS domain FROM {part}",
    "short_names": "SELECT p_partkey AS ref, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 11 = 0 THEN concat('http://example.org/', p_brand) WHEN p_partkey % 7 = 0 THEN concat('no_', p_brand) ELSE replace(p_name, ' ', '_') END AS uri, CASE WHEN p_partkey % 3 = 0 THEN 'old' WHEN p_partkey % 13 = 0 THEN 'none' ELSE lower(p_type) END AS source FROM {part}",
    "turtle": "SELECT concat('r', CAST(r_regionkey AS STRING)) AS file, concat('ex:', replace(r_name, ' ', '_'), ' a owl:Class ; rdfs:label \"', lower(r_name), '\"@en ; rdfs:comment \"Region ', r_name, '.\"@en .') AS body FROM {region} "
    "UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('ex:', n_name, ' a owl:Class ; rdfs:subClassOf ex:', replace(r_name, ' ', '_'), ' ; skos:prefLabel \"', lower(n_name), '\" ; rdfs:label \"other ', n_name, '\" .', chr(10), 'ex:has', n_name, ' a owl:ObjectProperty ; rdfs:domain ex:', replace(r_name, ' ', '_'), ' ; rdfs:range ex:', n_name, ' .', chr(10), 'ex:loose', n_name, ' a owl:ObjectProperty .') FROM {nation} JOIN {region} ON r_regionkey = n_regionkey "
    "UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('ex:', replace(s_name, '#', '_'), ' a owl:Class ; rdfs:subClassOf ex:', n_name, ' , ex:Unknown .') FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    sql = DERIVED[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def with_sql(*names: str) -> str:
    """Common table expressions that give the derived inputs."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({DERIVED[n].format(**{t: t for t in TABLES})})" for n in names)
