"""Message and session readers on odd payloads; every streaming operator against its batch form."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codequarry.operators import sessions as s
from codequarry.plans import session_queries
from codequarry.streaming import operators as streams

T0 = datetime(2025, 3, 1)
PAYLOADS = [
    ({"role": "ASSISTANT", "text": " hi "}, "assistant", "hi"),
    ({"role": 3, "type": "user", "content": [{"type": "text", "text": "a"}, {"type": "reasoning", "text": "no"}, {"text": "b"}, {"type": "text", "content": [{"text": "c"}, {"content": "d"}]}]}, "user", "a\nb\nc\nd"),
    ({"role": "other", "info": {"role": "tool"}, "response": "", "message": {"text": "deep"}}, "tool", "deep"),
    ({"choices": [{"message": {"content": "chosen"}}]}, None, "chosen"),
    ({"choices": [{"message": {"content": [{"type": "text", "text": "x"}]}}]}, None, "x"),
    ({"result": {"parts": [{"type": "text", "value": "v"}]}}, None, "v"),
    ({"parts": [{"type": "patch", "files": [" a.ts", "a.ts", "b.ts"]}]}, None, ""),
    ({}, None, ""),
]


def test_payloads(spark):
    rows = [(i, json.dumps(p)) for i, (p, *_) in enumerate(PAYLOADS)] + [(90, None), (91, "no json"), (92, "[1]"), (93, '"text"'), (94, "")]
    m = s.with_message_fields(spark.createDataFrame(rows, "pos int, payload string"))
    got = {r.pos: r for r in m.collect()}
    for i, (_, role, text) in enumerate(PAYLOADS):
        assert (got[i].role, got[i].reply) == (role, text)
    assert all(got[i].reply == "" and got[i].role is None and got[i].message_key == f"fallback:{i}" for i in range(90, 95))
    files = spark.createDataFrame(rows, "pos int, payload string").where("pos = 6").select(s.changed_paths(s.json("payload")).alias("f")).first().f
    assert files == ["a.ts", "b.ts"]
    assert m.limit(0).count() == 0


def test_message_keys_and_seen(spark):
    rows = [(0, '{"id": " m1 ", "role": "user", "text": "a  b"}'), (1, '{"role": "user", "text": "a\\n b", "createdAt": 1700000000}'), (2, '{"messageId": 7, "text": "x"}')]
    m = s.with_message_fields(spark.createDataFrame(rows, "pos int, payload string"))
    keys = [r.message_key for r in m.orderBy("pos").collect()]
    assert keys == ["id:m1:9:user|a b|", "content:user:1700000000000:3:a b", "id:7:10:unknown|x|"]
    fresh = s.fresh_messages(m, m.where("pos < 2"), ["message_key"])
    assert [r.pos for r in fresh.collect()] == [2]


def test_sessions(spark):
    rows = [
        ("a", {"time": {"updated": 1700000000}, "created": "2023-01-01 00:00:00", "cwd": "/w/x/"}), ("b", {"id": "ses_01HF7YAT00ABCDEFGHJKMNPQRS", "isActive": True}),
        ("c", {"status": " RUNNING ", "meta": {"updatedAt": "bad"}}), ("d", {"current": "true"}),
    ]
    got = {r.k: r for r in s.with_session_fields(spark.createDataFrame([(k, json.dumps(p)) for k, p in rows], "k string, payload string")).collect()}
    assert (got["a"].activity_ms, got["a"].created_ms, got["a"].project) == (1700000000000, 1672531200000, "/w/x")
    assert got["b"].created_ms == got["b"].activity_ms == 1700000000000 and got["b"].is_current and got["c"].is_current and got["c"].activity_ms == 0


def test_selectors_and_roots(spark):
    ses = spark.createDataFrame([("i1", "fix-bug", "Fix bug"), ("i2", "new-view", "New view"), ("i3", "new-page", "i1")], "id string, slug string, title string")
    ask = spark.createDataFrame([("fix-bug",), ("I1",), ("new view",), ("page",), ("new",), ("zzz",)], "selector string")
    got = {r.selector: (r.id, r.n_matches) for r in s.resolve_selector(ses, ask).collect()}
    assert got == {"fix-bug": ("i1", 1), "I1": ("i1", 1), "new view": ("i2", 1), "page": ("i3", 1), "new": (None, 2), "zzz": (None, 0)}
    roots = spark.createDataFrame([("/w", "all"), ("/w/x", "x")], "root string, scope string")
    paths = spark.createDataFrame([("/w/x/a",), ("/w/xy",), ("/w",), ("/v",), (None,)], "path string")
    assert {r.path: r.scope for r in s.root_of(paths, "path", roots).collect()} == {"/w/x/a": "x", "/w/xy": "all", "/w": "all", "/v": "custom", None: "custom"}


def test_unique_slugs_keep_long_names(spark, tmp_path):
    rows = [("a", "a long name with one end"), ("b", "a long name with another"), ("c", "x" * 60), ("d", "x" * 50)]
    spark.createDataFrame(rows, "id string, name string").write.parquet(str(tmp_path / "graph_nodes.parquet"))
    got = {r.key: r.slug for r in session_queries.unique_slugs(spark, str(tmp_path)).collect()}
    assert got == {"a": "a-long-name-with-one-end", "b": "a-long-name-with-another", "c": "x" * 48, "d": "x" * 48 + "-2"}


def test_key_search(spark):
    rows = [("a", '{"tokenCount": 3, "x": {"y": [{"tokens": "t"}, {"z": {"w": {"token": 1}}}]}}'), ("b", "cut {"), ("c", None), ("d", "{}")]
    got = {(r.k, r.path, r.value) for r in s.key_search(spark.createDataFrame(rows, "k string, p string"), "k", "p", "(?i)token").collect()}
    assert got == {("a", "$.tokenCount", "3"), ("a", "$.x.y[0].tokens", '"t"')}


def run_stream(spark, tmp_path, rows, schema, build, batches=4):
    """Plays rows as files in order of time; gives all rows that come out."""
    src, n = tmp_path / "in", -(-len(rows) // batches)
    for k in range(0, len(rows), n):
        spark.createDataFrame(rows[k : k + n], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = []
    q = build(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    q.stop()
    assert q.exception() is None
    return out


EVENTS = "k string, ts timestamp, n int"


@pytest.fixture(scope="module")
def events():
    r = random.Random(4)
    times = sorted(T0 + timedelta(seconds=r.randrange(4000)) for _ in range(120))
    return [(r.choice("abc"), t, i) for i, t in enumerate(times)]


def test_debounce(spark, tmp_path, events):
    last = [("end", T0 + timedelta(days=9), 0)]
    got = run_stream(spark, tmp_path, events + last, EVENTS, lambda e: streams.debounced(e, "k", "ts", "n", "60 seconds"))
    want = {tuple(r) for r in streams.debounced(spark.createDataFrame(events, EVENTS), "k", "ts", "n", "60 seconds").collect()}
    assert {g for g in got if g[0] != "end"} == want


def test_windows_and_dedupe(spark, tmp_path, events):
    last = [("end", T0 + timedelta(days=9), 0)]
    got = run_stream(spark, tmp_path, events + last, EVENTS, lambda e: streams.windowed_counts(e, "ts", "k", "10 minutes"))
    want = {tuple(r) for r in streams.windowed_counts(spark.createDataFrame(events, EVENTS), "ts", "k", "10 minutes").collect()}
    assert {g for g in got if g[1] != "end"} == want
    twice = run_stream(spark, tmp_path / "d", events + events, EVENTS, lambda e: streams.deduplicated(e, ["k", "n"], "ts", "3 hours").select("k", "n"))
    assert sorted(twice) == sorted((k, n) for k, _, n in events)


def test_dedupe_keeps_the_first_event(spark):
    rows = [("a", None, 0), ("a", T0 + timedelta(seconds=9), 1), ("a", T0, 3), ("a", T0, 2), (None, T0, 5), (None, T0, 4)]
    got = streams.deduplicated(spark.createDataFrame(rows, EVENTS).coalesce(1), ["k"], "ts").collect()
    assert {tuple(r) for r in got} == {("a", T0, 2), (None, T0, 4)}


def test_frames(spark, tmp_path):
    text = 'event: x\r\ndata: {"a":1}\r\n\r\n: note\n\ndata: [DONE]\n\ndata: {"b":\ndata: 2}\n\ndata: broken\n\ndata: {"c":3}\n\ndata: {"d"'
    cuts = [text[i : i + 7] for i in range(0, len(text), 7)]
    rows = [("x", T0 + timedelta(seconds=i), t) for i, t in enumerate(cuts)] + [("y", T0 + timedelta(seconds=i), t) for i, t in enumerate(["data: 1\n", "\n"])] + [("z", T0, None), (None, T0, "data: 1\n\n")]
    schema = "connection string, ts timestamp, text string"
    want = {("x", 0, '{"a":1}'), ("x", 1, '{"b":\n2}'), ("x", 3, '{"c":3}'), ("y", 0, "1")}
    assert {tuple(r) for r in streams.sse_payloads(spark.createDataFrame(rows, schema)).collect()} == want
    assert set(run_stream(spark, tmp_path, sorted(rows, key=lambda r: r[1]), schema, streams.sse_payloads)) == want
    assert streams.sse_payloads(spark.createDataFrame([], schema)).count() == 0


def test_terminal_events(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", at(0), "x"), ("b", at(0), "x"), ("c", at(1), "session.error"), ("a", at(2), "session.idle"), ("a", at(3), "session.error"), ("b", at(9), "session.idle"), ("d", at(600), "x")]
    schema = "k string, ts timestamp, kind string"
    want = {("a", "idle", at(2)), ("b", "timeout", at(5)), ("c", "error", at(1))}
    assert {tuple(r) for r in streams.until_terminal(spark.createDataFrame(rows, schema), "k", "ts", "kind").collect()} == want
    more = [*rows, ("e", at(700), "x"), ("f", at(701), "x")]
    got = run_stream(spark, tmp_path, more, schema, lambda e: streams.until_terminal(e, "k", "ts", "kind"), batches=len(more))
    assert {g for g in got if g[0] in "abc"} == want


def test_unseen_keeps_the_last_keys(spark, tmp_path):
    rows = [("a", f"m{i}") for i in range(30)] + [("a", "m29"), ("a", "m0"), ("b", "m29")]
    got = run_stream(spark, tmp_path, rows, "s string, key string", lambda e: streams.unseen_messages(e, "s", "key", most=10), batches=11)
    assert got.count(("a", "m29")) == 1 and got.count(("a", "m0")) == 2 and ("b", "m29") in got


def test_poll_deltas(spark, tmp_path):
    counts = [0, 0, 2, 2, 5, 5, 5, 5, 7]
    rows = [("a", T0 + timedelta(seconds=i), n) for i, n in enumerate(counts)] + [("b", T0 + timedelta(seconds=i), 0) for i in range(9)]
    rows.sort(key=lambda r: r[1])
    schema = "s string, ts timestamp, n long"
    batch = [tuple(r) for r in streams.poll_deltas(spark.createDataFrame(rows, schema), "s", "ts", "n", 3).collect()]
    a = [(added, done) for k, _, added, done in sorted(batch) if k == "a"]
    assert a == [(0, False), (0, False), (2, False), (0, False), (3, False), (0, False), (0, False), (0, True)]
    assert not any(done for k, *_, done in batch if k == "b")
    assert sorted(run_stream(spark, tmp_path, rows, schema, lambda p: streams.poll_deltas(p, "s", "ts", "n", 3))) == sorted(batch)


def test_reindex_sink(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "project_path string, file_path string, line string"
    sink = streams.reindex_sink(path, lambda b: b.select("project_path", "file_path", F.upper("line").alias("line")), ["file_path"])
    sink(spark.createDataFrame([("/p", "a", "x"), ("/p", "a", "y"), ("/p", "b", "z"), ("/q", "a", "q")], schema), 0)
    other = sorted((tmp_path / "index").glob("project_path=*q/*.parquet"))
    sink(spark.createDataFrame([("/p", "a", "new")], schema), 1)
    sink(spark.createDataFrame([("/p", "a", "new")], schema), 1)  # a repeated batch changes nothing
    assert {tuple(r) for r in spark.read.schema(schema).parquet(path).select("project_path", "file_path", "line").collect()} == {("/p", "a", "NEW"), ("/p", "b", "Z"), ("/q", "a", "Q")}
    assert other and other == sorted((tmp_path / "index").glob("project_path=*q/*.parquet"))  # another project's files stay
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file_path string, file_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "file_path string, file_hash string")
    assert {tuple(r) for r in streams.watched_changes(old, now).collect()} == {("b", "change"), ("d", "add")}


def test_key_search_and_selectors_without_loops(spark):
    rows = spark.createDataFrame([("a", '{"Token": 1, "x": {"my_token": {"token": [1]}}, "l": [{"token": 2}, 5]}'), ("b", "[[{\"token\": 3}]]"), ("c", "{"), ("d", None), ("e", "{}")], "id string, m string")
    found = s.key_search(rows, "id", "m", "(?i)token")
    assert {tuple(r) for r in found.collect()} == {("a", "$.Token", "1"), ("a", "$.x.my_token", '{"token":[1]}'), ("a", "$.x.my_token.token", "[1]"), ("a", "$.l[0].token", "2"), ("b", "$[0][0].token", "3")}
    assert {tuple(r) for r in s.key_search(rows, "id", "m", "(?i)token", depth=0).collect()} == {("a", "$.Token", "1")}
    assert found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Generate explode") == 1
    held = spark.createDataFrame([("1", "AlphaOne", "First"), ("2", "BetaTwo", "Second one"), ("3", None, None), ("4", "AlphaOne", "x")], "id string, slug string, title string")
    asked = spark.createDataFrame([("alphaone",), ("2",), ("TWO",), ("st",), ("o",), ("none",), ("",), (None,), ("second ONE",)], "selector string")
    out = s.resolve_selector(held, asked)
    assert {tuple(r) for r in out.collect()} == {("alphaone", "1", 1), ("2", "2", 1), ("TWO", "2", 1), ("st", "1", 1), ("o", None, 3), ("none", None, 0), ("second ONE", "2", 1)}
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and s.resolve_selector(held.limit(0), asked).count() == 7


def test_groups_numbers_and_fallbacks(spark):
    rows = spark.createDataFrame([("u", "a", 1), ("u", "b", 3), ("u", "b", 0), ("v", "c", None), ("w", "d", 2), (None, "e", 1)], "owner string, grp string, n int")
    assert {tuple(r) for r in s.best_group(rows, "owner", "grp", F.coalesce("n", F.lit(0))).collect()} == {("u", "b", 3), ("v", "c", 0), ("w", "d", 2), (None, "e", 1)}
    assert {r.owner: r.free for r in s.first_free(rows, "owner", "n").collect() if r.owner} == {"u": 2, "w": 1}
    assert {r.grp for r in s.fallback_rows(rows, "owner", F.col("n") > 2).collect()} == {"b", "c", "d"}
    assert {tuple(r) for r in s.first_source([rows.select("grp"), spark.createDataFrame([("a",), ("z",), (None,)], "grp string")], "grp").collect()} == {("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 0), ("z", 1)}
    assert {(r.owner, r.grp): r.place for r in s.ranked(rows.select("owner", "grp").distinct(), "owner", "grp", ("b",)).collect()}["u", "b"] == 1
    v = spark.createDataFrame([('{"properties": {"info": {"sessionID": " s1 "}}}',), ('{"session": {"id": "s2"}}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in v.select(s.event_session(s.json("p"))).collect()] == ["s1", "s2", None, None]


def test_polls_of_a_batch(spark):
    schema = "s string, ts timestamp, n long"
    rows = [("a", T0, 1), ("a", T0, 1), ("a", T0 + timedelta(seconds=1), None), ("a", T0 + timedelta(seconds=2), 0), ("a", T0 + timedelta(seconds=3), 9), ("z", T0, None)]
    out = streams.poll_deltas(spark.createDataFrame(rows, schema), "s", "ts", "n", 2)
    assert [(r.added, r.done) for r in out.orderBy("s", "ts", "done").collect()] == [(1, False), (0, False), (0, True), (0, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert streams.poll_deltas(spark.createDataFrame([], schema), "s", "ts", "n").count() == 0


def test_patches_labels_and_lists(spark):
    rows = [(0, '{"id": "m", "message": {"parts": [{"type": "patch", "files": ["b.ts", " b.ts ", "a.ts"]}]}}'), (1, '{"id": "m", "text": "patch"}')]
    m = s.with_message_fields(spark.createDataFrame(rows, "pos int, payload string"))
    flat = "unknown||```text Code changes: - b.ts - a.ts ```"
    assert [r.message_key for r in m.orderBy("pos").collect()] == [f"id:m:{len(flat)}:{flat}", "id:m:14:unknown|patch|"]
    names = spark.createDataFrame([("b", 1), ("B", 2), ("a", 3), ("É", 4), ("f", 5), (None, 6)], "n string, i int")
    assert [r.n for r in s.by_label(names, "n").collect()] == [None, "a", "b", "B", "É", "f"]
    roots, more = spark.createDataFrame([("/a", 1)], "path string, n int"), spark.createDataFrame([("/a", 2), ("/b", 3), (None, 4)], "path string, n int")
    assert {tuple(r) for r in s.with_unlisted(roots, more, "path").collect()} == {("root", "/a", 1), ("instance", "/b", 3)}
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "c string")
    pick = lambda *f: [tuple(r) for r in s.merged_commands(*f, "c").collect()]
    assert pick(one("a", "b"), one("b", "c"), one("d")) == [("a", 0), ("b", 0), ("c", 1)]
    assert pick(one("a"), one(None), one("d", "a")) == [("a", 0), ("d", 1)]
