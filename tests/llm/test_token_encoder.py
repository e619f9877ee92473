"""Word-by-word encoding against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from strata.llm.token_store import Encoder, write_tokens, read_tokens

ODD = [None, "", "  ", "a", "a ", "\n", "a\nb", "a  b c", "x\n  bar", "Hi there!! Ok?", "...", "a. .b ..c", "é. ça, où?", "<|endoftext|> x", "it's o'clock. 12.5, x_y!", "x" * 5000 + ". y", "ab\tcd", "日本語、テスト。 中文！ ok!", "a!b! c?!d?!", "tab\x0bx", "a\r\nb", "x\n  bar", "u　v  w", " z"]


def check(encoder, texts):
    got = encoder.encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], repr(text)


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    rng = random.Random(5)
    parts = ["a", "B1", " ", " ", "\n", ".", "!", "é", "'s", "_", "<|", " ", "ß,", "\t"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    check(encoder, texts)
    check(encoder, texts[::-1])
    monkeypatch.setattr("strata.llm.token_store._ENTRIES", 5)
    for at in range(0, len(texts), 500):
        check(encoder, texts[at : at + 500])
    check(encoder, [])


def test_dictionary_is_drawn_from_the_whole_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"source {i % 7} says " + "word " * (i % 30)) for i in range(400)], "doc_id long, text string")
    kept = []
    for k, frame in enumerate((docs, docs.orderBy(docs.doc_id.desc()))):
        path = f"{tmp_path}/{k}"
        write_tokens(frame, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), sample=100, sample_chars=120)
        kept.append(spark.read.parquet(f"{path}/dictionary").first().hash)
        assert read_tokens(spark, path).count() == 400
    assert kept[0] == kept[1]
