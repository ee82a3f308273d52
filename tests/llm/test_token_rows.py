"""Ids of many texts at once are those of the texts one by one, and each different part is looked up once."""

import random

import numpy as np
import pyarrow as pa
from corpuslake.llm import token_store, tokens

ODD = ["", None, " ", "  two", "two ", "a\n b", "a \n b", "a.\nB", "a.\n\nB", "a.\n\n B", "a.\n", "it's", "it's. We'll", "x%%%", "x. y.", "é.\nÈÉ", "ß×÷ a×b", "日本 語. a", "a 日本", "٣a. b٣", "z\x1c a \x85b", "<|endoftext|> a", "\nA.\nB", "a1. b2.\nc3", "...", "a...\nb\nc", "ª. º.\nµ", "x" * 200 + ". " + "y" * 200, "ſ. Å.\nÅ", "a.b,c\nD e"]


def test_all_rows_are_as_one_by_one():
    draw, enc, end = random.Random(4), tokens.Encoder(tokens.default_tokenizer(), 60), np.array([tokens.END_ID], "<u4")
    letters = ["a", "bc", "É", "ẞ", "1", ".", ",", "'s", "\n", " ", " ", "  ", "\t", "%", "語", "-", "@"]
    texts = ODD + ["".join(draw.choices(letters, k=draw.randrange(30))) for _ in range(2000)]
    whole = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = enc.all_raw(pa.array(["no", *texts], kind)[1:], end.tobytes())
        assert counts.tolist() == [len(w) + 1 for w in whole] and ids.tolist() == [i for w in whole for i in [*w, 2]]
    ids, counts = enc.all_raw(pa.array([None, ""]))
    assert len(ids) == 0 and counts.tolist() == [0, 0] and len(enc.all_raw(pa.array([], pa.string()))[1]) == 0


def test_repeated_parts_are_looked_up_once():
    enc, asked = tokens.Encoder(tokens.default_tokenizer()), []
    enc.merge = lambda letters, merge=enc.merge: asked.append(letters) or merge(letters)
    enc.all_raw(pa.array(["one two. three.\nOne two " * 50] * 20))
    assert len(asked) == len(set(asked)) < 10


def test_files_end_with_the_document_that_fills_them(spark, tmp_path):
    rows = [(k, "word " * (k % 7)) for k in range(90)]
    made = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"file://{tmp_path}/t", tokens.default_tokenizer(), file_ids=10).orderBy("part", "number").collect()
    assert sum(r.n_docs for r in made) == 90 and len(made) > 20
    for one, after in zip(made, made[1:], strict=False):
        assert one.n_ids >= 10 or after.part > one.part


def test_batches_are_cut_by_the_size_of_their_texts():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 50, None, "", "y" * 500, "z" * 10, "w" * 90])], ["id", "text"])
    assert [s.column(0).to_pylist() for s in token_store._by_size(batch, 100)] == [[0, 1, 2, 3], [4, 5]]
    assert sum(map(len, token_store._by_size(batch.slice(0, 0)))) == 0
