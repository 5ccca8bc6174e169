import time

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import split_chunks as split

SCHEMA = "id string, project_path string, content string, start_line int, piece int, overlap int"
CONFIG = "project_path string, max_chunk_size int, overlap int, strategy string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r{}é字。", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_give_the_text_back(text, limit, overlap):
    spans = split.bisect_spans(text, limit, overlap)
    whole, at = "", 0
    for k, (s, e) in enumerate(spans):
        assert e - s <= limit and (s <= at < e or not text)
        if k:
            assert at - s == min(min(overlap, limit - 1), at)
        whole += text[at:e]
        at = e
    assert whole == text


def test_cuts_at_natural_places():
    text = "def a():\n    return 1\n\n" * 4
    assert all(text[s:e].startswith("def") for s, e in split.bisect_spans(text, 60, 0))
    assert split.bisect_spans("aaaa bbbb", 5, 0) == [(0, 5), (5, 9)]
    assert all("\r\n" not in "x" + text2[e - 1 : e + 1] for text2 in ["ab\r\n" * 5] for _, e in split.bisect_spans(text2, 7, 0)[:-1])


def test_long_blank_texts_stay_linear():
    for text in ("x" + "\n" * 1_000_000, " \r\n" * 300_000, "}" * 500_000 + " " * 500_000, "\n\n" * 200_000 + "x"):
        began = time.time()
        spans = split.bisect_spans(text, 5000, 50)
        assert time.time() - began < 20 and spans[-1][1] == len(text) and all(e - s <= 5000 for s, e in spans)


def test_rows(spark):
    rows = [
        ("a", "p", "x" * 11, 5, 1, 1), ("a", "p", "x" * 11, 5, 1, 1), ("b", "p", "x" * 10, 1, 1, 1), ("c", "p", None, 1, 1, 1), ("d", "q", "x" * 99, 1, 1, 1),
        ("e", "p", "", 1, 1, 1), ("f", "p", "l1\r\nl2\rl3\nl4 end", 7, 1, 1), ("g", "p", "y" * 12, None, 1, 1), ("h", "r", "z" * 50, 1, 1, 1), ("i", "p", "字" * 200_000, 1, 1, 1),
    ]
    config = spark.createDataFrame([("p", 10, 4, "s"), ("r", None, None, "s")], CONFIG)
    got = split.split_oversized(spark.createDataFrame(rows, SCHEMA), config)
    assert {r.id for r in split.oversized_ids(got).collect()} == {"a", "f", "g", "i"}
    by = {}
    for r in got.where("id <> 'i'").orderBy("id", "piece").collect():
        by.setdefault(r.id, []).append(r)
    assert [r.piece for r in by["a"]] == list(range(by["a"][0].n_pieces))
    assert all(len(r.content) <= 10 for rs in by.values() for r in rs)
    text = "l1\r\nl2\rl3\nl4 end"
    for r in by["f"]:
        assert r.content == text[r.start_offset : r.end_offset]
    assert by["f"][0].start_line == 7 and by["f"][-1].end_line == 10 and by["g"][0].start_line is None
    assert split.split_oversized(spark.createDataFrame([], SCHEMA), config).count() == 0
