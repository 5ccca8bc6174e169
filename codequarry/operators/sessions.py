"""Semi-structured sessions and messages: JSON payloads probed through candidate paths, then ranked, keyed and compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.functions import text as fx

#: Where a payload may hold each thing, in the order in which they are tried.
ROLES = ("assistant", "user", "system", "tool")
ROLE_PATHS = ("$.role", "$.type", "$.info.role", "$.info.type", "$.author.role", "$.metadata.role", "$.properties.role")
TEXT_PATHS = (
    "$.response", "$.message", "$.reply", "$.outputText", "$.text", "$.content", "$.result.text", "$.result.content",
    "$.message.content", "$.message.text",
)
PART_PATHS = ("$.parts", "$.result.parts", "$.message.parts", "$.content", "$.result.content", "$.message.content", "$.output")
PATCH_PATHS = ("$.parts", "$.message.parts", "$.result.parts")
ID_PATHS = ("$.id", "$.messageId", "$.info.id", "$.info.messageID", "$.uuid", "$.ulid", "$.eventId", "$.metadata.id", "$.properties.id")
TIME_PATHS = (
    "$.createdAt", "$.created_at", "$.timestamp", "$.info.time.created", "$.info.time.createdAt", "$.info.createdAt",
    "$.info.created_at", "$.time.createdAt", "$.time.created",
)
UPDATED_PATHS = (
    "$.time.updated", "$.time.updatedAt", "$.updatedAt", "$.updated_at", "$.updated", "$.lastUpdated", "$.last_message_at",
    "$.lastMessageAt", "$.lastActivityAt", "$.last_activity_at", "$.meta.updatedAt", "$.metadata.updatedAt",
)
CREATED_PATHS = (
    "$.time.created", "$.time.createdAt", "$.createdAt", "$.created_at", "$.created", "$.startTime", "$.startedAt",
    "$.meta.createdAt", "$.metadata.createdAt",
)
PROJECT_PATHS = (
    "$.cwd", "$.projectPath", "$.workspacePath", "$.directory", "$.workingDirectory", "$.workdir", "$.meta.cwd",
    "$.meta.projectPath", "$.metadata.cwd", "$.metadata.projectPath", "$.context.cwd", "$.context.projectPath", "$.config.cwd",
    "$.config.projectPath",
)
EVENT_SESSION_PATHS = (
    "$.sessionID", "$.sessionId", "$.session.id", "$.info.sessionID", "$.info.sessionId", "$.info.session.id",
    "$.properties.sessionID", "$.properties.sessionId", "$.properties.session.id", "$.properties.info.sessionID",
    "$.properties.info.sessionId",
)
STATE_PATHS = ("$.state", "$.status", "$.lifecycle.state", "$.meta.state", "$.metadata.state", "$.session.state")
CURRENT_PATHS = (
    "$.current", "$.isCurrent", "$.active", "$.isActive", "$.selected", "$.isSelected", "$.meta.current", "$.meta.active",
    "$.metadata.current", "$.metadata.active", "$.session.current",
)
CURRENT_STATES = ("current", "active", "selected", "running")


def json(payload: str | Column) -> Column:
    """A variant; null for text that is no JSON."""
    return F.try_parse_json(payload)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_at(v: Column, path: str) -> Column:
    """The string at a path; null for other types."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def scalar_at(v: Column, path: str) -> Column:
    """A string or a number as text."""
    kind = F.schema_of_variant(_at(v, path))
    return F.when(kind.rlike(r"^(?:STRING|BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "string"))


#: From the first to the last character that is no white space.
_FILLED = r"[^\s\p{Z}\x{FEFF}](?:[\s\S]*[^\s\p{Z}\x{FEFF}])?"


def _filled(c: Column) -> Column:
    """A text without outer white space; null where nothing is left."""
    return F.regexp_substr(c, F.lit(_FILLED))


def first_string(v: Column, paths: Sequence[str]) -> Column:
    """The first string that isn't blank, trimmed. Paths after it are not looked at."""
    return F.coalesce(*[_filled(string_at(v, p)) for p in paths])


def role(v: Column) -> Column:
    """assistant, user, system or tool, by the first candidate that names one; else null."""
    known = F.lit(rf"\A(?:{'|'.join(ROLES)})\z")
    return F.coalesce(*[F.regexp_substr(F.lower(string_at(v, p)), known) for p in ROLE_PATHS])


def parts_text(v: Column, path: str, reasoning: bool = False) -> Column:
    """The text of a list of parts, one a line; parts of other kinds are left out. Null if there is none."""
    kinds = ["", "text", *(["reasoning"] if reasoning else [])]
    parts = F.try_variant_get(v, path, "array<variant>")
    kept = F.filter(parts, lambda p: F.coalesce(F.lower(string_at(p, "$.type")), F.lit("")).isin(*kinds))

    def text_of(p: Column) -> Column:
        inner = F.transform(F.try_variant_get(p, "$.content", "array<variant>"), lambda i: F.coalesce(string_at(i, "$.text"), string_at(i, "$.content")))
        return F.coalesce(string_at(p, "$.text"), string_at(p, "$.value"), string_at(p, "$.content"), F.array_join(F.filter(inner, lambda s: s != ""), "\n"))

    return F.nullif(fx.strip(F.array_join(F.transform(kept, text_of), "\n")), F.lit(""))


def reply_text(v: Column, reasoning: bool = False) -> Column:
    """A payload's text: direct strings, then lists of parts, then the first choice; empty if there is none."""
    choice = "$.choices[0].message.content"
    found = [first_string(v, TEXT_PATHS), *[parts_text(v, p, reasoning) for p in PART_PATHS], first_string(v, [choice]), parts_text(v, choice)]
    return F.coalesce(*found, F.lit(""))


def first_time(v: Column, paths: Sequence[str]) -> Column:
    """The first positive time among the candidates, in epoch milliseconds; else 0."""
    one = lambda p: F.get(F.filter(F.transform(F.array(scalar_at(v, p)), lambda x: fx.epoch_ms(x)), lambda t: t > 0), F.lit(0))
    return F.coalesce(*map(one, paths), F.lit(0).cast("long"))


def changed_paths(v: Column) -> Column:
    """Up to 40 distinct files of the patch parts, from the first place that holds a list of parts; null without such a list."""
    parts = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in PATCH_PATHS])
    patches = F.filter(parts, lambda p: string_at(p, "$.type") == "patch")
    files = F.flatten(F.transform(patches, lambda p: F.coalesce(F.try_variant_get(p, "$.files", "array<string>"), F.array().cast("array<string>"))))
    return F.slice(F.array_distinct(F.filter(F.transform(files, fx.strip), lambda f: f != "")), 1, 40)


def patch_summary(v: Column) -> Column:
    """The changed files as a list in a text block; empty if there are none."""
    listed = F.transform(changed_paths(v), lambda f: F.concat(F.lit("- "), f))
    block = F.concat(F.lit("```text\nCode changes:\n"), F.array_join(listed, "\n"), F.lit("\n```"))
    return F.when(F.size(listed) > 0, block).otherwise("")


def with_message_fields(messages: DataFrame, payload: str = "payload", position: str = "pos") -> DataFrame:
    """``role, reply, created_ms, message_key`` beside the columns given. The payload is parsed once.

    The key is by id and fingerprint (role, text and changed files), else by content and time, else by position.
    """
    m = messages.withColumn("_v", json(payload))
    v = F.col("_v")
    m = m.withColumn("role", role(v)).withColumn("reply", reply_text(v)).withColumn("created_ms", first_time(v, TIME_PATHS))
    known = F.coalesce("role", F.lit("unknown"))
    own = F.coalesce(*[_filled(scalar_at(v, p)) for p in ID_PATHS])
    flat = fx.strip(F.regexp_replace("reply", r"\s+", " "))
    patch = F.when(F.contains(payload, F.lit("patch")), patch_summary(v))  # most payloads have none, and aren't searched for it
    content = F.concat_ws(":", F.lit("content"), known, F.col("created_ms").cast("string"), F.length(flat).cast("string"), F.substring(flat, 1, 400))
    key = F.when(own.isNotNull(), F.concat_ws(":", F.lit("id"), own, fx.fingerprint(known, F.col("reply"), patch))).when(flat != "", content)
    return m.withColumn("message_key", F.coalesce(key, F.concat(F.lit("fallback:"), F.col(position).cast("string")))).drop("_v")


def latest_reply(messages: DataFrame, session: str, position: str = "pos") -> DataFrame:
    """``session, reply``: the last assistant message with text, else the last message with text."""
    best = F.max(F.struct((F.coalesce("role", F.lit("")) == "assistant").alias("a"), position, "reply"))
    return messages.where(F.col("reply") != "").groupBy(session).agg(best.alias("b")).select(session, F.col("b.reply").alias("reply"))


def last_messages(messages: DataFrame, session: str, position: str, n: int) -> DataFrame:
    """The last n messages of each session. Spark keeps n rows a session before the shuffle."""
    w = W.partitionBy(session).orderBy(F.desc(position))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fresh_messages(messages: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return messages.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def with_session_fields(sessions: DataFrame, payload: str = "payload") -> DataFrame:
    """``updated_ms, created_ms, activity_ms, state, is_current, project`` beside the columns given.

    created falls back to updated, then to the time in the id; activity is updated, else created.
    """
    s = sessions.withColumn("_v", json(payload))
    v = F.col("_v")
    s = s.withColumn("updated_ms", first_time(v, UPDATED_PATHS))
    made = F.coalesce(F.nullif(first_time(v, CREATED_PATHS), F.lit(0)), F.nullif("updated_ms", F.lit(0)), fx.ulid_ms(string_at(v, "$.id")), F.lit(0))
    s = s.withColumn("created_ms", made).withColumn("activity_ms", F.coalesce(F.nullif("updated_ms", F.lit(0)), "created_ms"))
    s = s.withColumn("state", F.lower(F.coalesce(first_string(v, STATE_PATHS), F.lit(""))))
    flag = F.coalesce(*[F.when(F.try_variant_get(v, p, "boolean"), True) for p in CURRENT_PATHS], F.lit(False))
    project = F.coalesce(*[fx.normal_path(string_at(v, p)) for p in PROJECT_PATHS])
    return s.withColumn("is_current", flag | F.col("state").isin(*CURRENT_STATES)).withColumn("project", project).drop("_v")


def belongs_to(project: str | Column, root: str | Column) -> Column:
    """Whether a path is the root or lies below it."""
    p, r = (F.col(c) if isinstance(c, str) else c for c in (project, root))
    return F.coalesce((p == r) | p.startswith(F.concat(r, F.lit("/"))), F.lit(False))


def root_of(paths: DataFrame, path: str, roots: DataFrame, default: str = "custom") -> DataFrame:
    """``paths`` with ``scope``: that of the longest root above the path, else the default.

    A path is listed under each of its folders and joined to the roots by equality.
    """
    steps = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    listed = paths.select(path).where(F.col(path).isNotNull()).distinct().select(path, F.explode(above).alias("root"))
    hits = listed.join(roots.select("root", "scope").distinct(), "root").groupBy(path).agg(F.max(F.struct(F.length("root"), "scope")).alias("m"))
    return paths.join(hits.select(path, F.col("m.scope").alias("scope")), path, "left").na.fill(default, ["scope"])


def pick_session(sessions: DataFrame, owner: str, current: str, existing: str, order: Sequence[str]) -> DataFrame:
    """``owner, session``: the flagged session, else the existing one if it is still listed, else the first in order."""
    rank = F.struct(F.when(F.col(current), 0).when(F.col("id") == F.col(existing), 1).otherwise(2).alias("p"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("id").alias("session"))
    return sessions.groupBy(owner).agg(F.min(rank).alias("m")).select(owner, F.col("m.session").alias("session"))


def _grams(text: str | Column) -> Column:
    """The distinct pieces of one, two and three characters of a text in lower case."""
    t = F.lower(text)
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(t) >= n, piece(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])))


def resolve_selector(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """``selector, id, n_matches``: sessions (id, slug, title) that each selector means.

    Tiers in order: slug, id, title in any case, then a unique part of slug or title; several parts match none (id null)
    and n_matches tells how many. Null and empty selectors are none. All tiers are equi-joins: what the exact ones leave is
    looked up by the selector's first three characters among the pieces of slugs and titles, and then compared as a whole.
    """
    asked = asked.select("selector").where(F.col("selector") != "").distinct()
    low = F.lower("selector")
    keys = sessions.select("id", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.lower("slug").alias("k")), F.struct(F.lit(1).alias("tier"), F.lower("id").alias("k")), F.struct(F.lit(2).alias("tier"), F.lower("title").alias("k")))).alias("t")).select("id", "t.tier", "t.k")
    exact = asked.join(keys, low == F.col("k")).groupBy("selector").agg(F.min(F.struct("tier", "id")).alias("m")).select("selector", F.col("m.id").alias("id"), F.lit(1).cast("long").alias("n_matches"))
    rest = asked.join(exact.select("selector"), "selector", "left_anti").withColumn("gram", F.substring(low, 1, 3))
    names = sessions.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("slug"), F.lower("title"))))).alias("name"))
    pieces = names.select("id", "name", F.explode(_grams("name")).alias("gram"))
    hits = rest.join(pieces, "gram").where(F.contains("name", low)).groupBy("selector").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    part = rest.join(hits, "selector", "left").select("selector", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))
    return exact.unionByName(part)


def key_search(rows: DataFrame, key: str, payload: str, pattern: str, depth: int = 3) -> DataFrame:
    """``key, path, value``: every object entry whose name matches, down to a depth below the top; arrays are entered.

    A payload is parsed once; its levels are arrays of one row, which is exploded once.
    """
    empty = F.array().cast("array<struct<path:string,name:string,v:variant>>")

    def below(path: Column, v: Column) -> Column:
        """The entries and items right below a value."""
        entries = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["key"].alias("name"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.lit("").alias("name"), x.alias("v")))
        return F.coalesce(entries, items, empty)

    out = rows.select(key, json(payload).alias("v")).where(F.col("v").isNotNull()).withColumn("l0", below(F.lit("$"), F.col("v")))
    for i in range(1, depth + 1):
        out = out.withColumn(f"l{i}", F.flatten(F.transform(f"l{i - 1}", lambda e: below(e["path"], e["v"]))))
    found = F.filter(F.concat(*[f"l{i}" for i in range(depth + 1)]), lambda e: (e["name"] != "") & e["name"].rlike(pattern))
    return out.select(key, F.explode(found).alias("e")).select(key, "e.path", F.to_json("e.v").alias("value"))


def event_session(v: Column) -> Column:
    """The session that an event's payload speaks of: the first id among the candidates; null if there is none."""
    return first_string(v, EVENT_SESSION_PATHS)


def best_group(scored: DataFrame, owner: str, group: str, score: Column) -> DataFrame:
    """``owner, group, score``: of each owner's groups the one with the largest sum, then most rows, then the last name."""
    s = scored.groupBy(owner, group).agg(F.sum(score).alias("score"), F.count("*").alias("n"))
    return s.groupBy(owner).agg(F.max(F.struct("score", "n", group)).alias("m")).select(owner, F.col(f"m.{group}").alias(group), F.col("m.score").alias("score"))


def first_free(rows: DataFrame, owner: str, number: str) -> DataFrame:
    """``owner, free``: the smallest number from 1 on that no row of the owner has. Gaps are found by an anti-join."""
    n = rows.select(owner, F.col(number).cast("long").alias("n")).where(F.col("n") >= 1).distinct()
    after = n.select(owner, (F.col("n") + 1).alias("n")).unionByName(n.select(owner, F.lit(1).cast("long").alias("n"))).distinct()
    return after.join(n, [owner, "n"], "left_anti").groupBy(owner).agg(F.min("n").alias("free"))


def fallback_rows(rows: DataFrame, owner: str, wanted: Column) -> DataFrame:
    """The wanted rows of each owner, and all rows of owners that have none. A null wish is no wish."""
    marked = rows.withColumn("_hit", F.coalesce(wanted, F.lit(False)))
    some = marked.groupBy(owner).agg(F.max("_hit").alias("_some"))
    return marked.join(some, owner).where(F.col("_hit") | ~F.col("_some")).drop("_hit", "_some")


def first_source(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """``key, source``: each key of the frames once, with the number of the first frame that has it. Nulls are none."""
    out: DataFrame | None = None
    for i, s in enumerate(sources):
        part = s.select(F.col(key), F.lit(i).alias("source")).where(F.col(key).isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("source").alias("source"))


def ranked(rows: DataFrame, owner: str, kind: str, first: Sequence[str]) -> DataFrame:
    """``rows`` (one a kind of each owner) with ``place``: the kinds named first in that order, then the others by name, as a
    dictionary orders them (by letters before case)."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(first)], F.lit(len(first)))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(rank, F.collate(kind, "UNICODE"), kind)))


def by_label(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` in the order of a dictionary of the columns, say a label and then a name; nulls first."""
    return rows.orderBy(*[F.collate(c, "UNICODE") for c in columns], *columns)


def with_unlisted(listed: DataFrame, others: DataFrame, key: str, kind: Sequence[str] = ("root", "instance")) -> DataFrame:
    """``type`` and the columns of ``listed``: its rows, and those of ``others`` whose key it doesn't have. Null keys are none."""
    new = others.where(F.col(key).isNotNull()).join(listed.select(key).distinct(), key, "left_anti")
    return listed.select(F.lit(kind[0]).alias("type"), *listed.columns).unionByName(new.select(F.lit(kind[1]).alias("type"), *listed.columns))


def merged_commands(fixed: DataFrame, found: DataFrame, fallback: DataFrame, key: str, most: int = 100) -> DataFrame:
    """``key, source``: fixed commands, then those found, or the fallback where none was found; each once, the first ``most``."""
    some = fallback if found.where(F.col(key).isNotNull()).isEmpty() else found
    return first_source([fixed, some], key).orderBy("source", key).limit(most)
