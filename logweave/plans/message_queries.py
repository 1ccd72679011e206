"""Queries over bound messages, tool messages, index entries and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.presets import PRESETS
from ..operators import catalog as C
from ..operators import compare as D
from ..operators import context, reading, render, slicing as S, stats as A
from ..scratch import new_path
from ..sources import writers
from . import views as V

QUERIES: dict = {}

BUDGET = 400
WORD = "the"

#: Bound tables in SQL.
CONV = """c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS idx, role, text, 4 + CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS cost,
  ['claude','codex','gemini','copilot','cursor-agent','commandcode','goose','opencode','kiro','zed'][CAST(conv_id % 10 + 1 AS INTEGER)] AS source,
  TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS ts FROM conversations)"""
TOOL = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'click' THEN 'Edit' ELSE event_type END AS name, '/f/' || json_extract_string(props, '$.k') AS file,
  'c' || CAST(event_id % 40 AS VARCHAR) AS call, event_type = 'error' AS failed, 'done ' || repeat(props, CAST(event_id % 20 + 1 AS INTEGER)) AS output, CAST(user_id AS VARCHAR) AS session_id FROM events)"""
#: Length of the compact JSON of a tool call's arguments: {"file_path":"...","q":"..."} with the quotes of props escaped.
ARGS = "length('{\"file_path\":\"' || file || '\",\"q\":\"' || replace(props, '\"', '\\\"') || '\"}')"
INDEX = f"""{CONV}, ix AS (
  SELECT session_id AS id, source, '/p/' || CAST(conv_id % 7 AS VARCHAR) AS cwd, max(ts) AS updated_at, substr(arg_min(text, idx) FILTER (WHERE role = 'user'), 1, 60) AS summary, '/t/' || session_id || '.jsonl' AS file_path FROM c GROUP BY conv_id, session_id, source
  UNION ALL SELECT CAST(user_id AS VARCHAR), ['claude','codex','gemini','copilot','cursor-agent','commandcode','goose','opencode','kiro','zed'][CAST((user_id + 1) % 10 + 1 AS INTEGER)], '/p/' || CAST(user_id % 7 AS VARCHAR), max(ts), NULL, '/u/' || CAST(user_id AS VARCHAR) FROM events GROUP BY user_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, list_position(['claude','codex','gemini','copilot','cursor-agent','commandcode','goose','opencode','kiro','zed'], source), file_path) AS r FROM ix),
dedup AS (SELECT * EXCLUDE (r) FROM ranked WHERE r = 1)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


def trimmed(chosen: str) -> str:
    """SQL of W5 over a table of (session_id, idx, role, ...) in position order."""
    return f"""{chosen}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS q, count(*) OVER (PARTITION BY session_id) AS qn FROM chosen),
la AS (SELECT *, max(CASE WHEN role = 'assistant' THEN q END) OVER (PARTITION BY session_id) AS la FROM n),
cut AS (SELECT * FROM la WHERE la IS NULL OR 2 * la < qn OR q <= la)"""


def _slice(anchor: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = V.conversation_messages(spark, sf_dir)
        return S.slice_sessions(m, BUDGET, anchor, WORD if anchor == "search" else None).select("session_id", "idx", "role", "cost")
    return run


def chosen(order: str) -> str:
    return f"""{CONV}, run AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY {order}) AS total, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS rank FROM c),
chosen AS (SELECT * FROM run WHERE rank = 1 OR total <= {BUDGET})"""


SEARCH = f"""{CONV}, p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY session_id) AS cnt FROM c WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
ctr AS (SELECT *, coalesce(min(CASE WHEN contains(lower(text), '{WORD}') THEN pos END) OVER (PARTITION BY session_id), cnt) AS center FROM p),
rk AS (SELECT *, CASE WHEN pos < center THEN (center - pos) + least(center - pos - 1, cnt - center) WHEN pos > center THEN (pos - center) + least(pos - center, center - 1) ELSE 0 END AS rank FROM ctr),
run AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY rank) AS total FROM rk),
chosen AS (SELECT * FROM run WHERE rank = 0 OR total <= {BUDGET})"""

QUERIES["w2_head_slice"] = (_slice("head"), f"WITH {trimmed(chosen('idx'))} SELECT session_id, idx, role, cost FROM cut")
QUERIES["w3_tail_slice"] = (_slice("tail"), f"WITH {trimmed(chosen('idx DESC'))} SELECT session_id, idx, role, cost FROM cut")
QUERIES["w4_search_slice"] = (_slice("search"), f"WITH {trimmed(SEARCH)} SELECT session_id, idx, role, cost FROM cut")


@query("w9_slice_meta", f"""WITH {trimmed(chosen('idx DESC'))}, t AS (SELECT session_id, source, count(*) AS n, sum(cost) AS s FROM c GROUP BY session_id, source), g AS (SELECT session_id, count(*) AS k, sum(cost) AS s, min(idx) AS a, max(idx) AS b FROM cut GROUP BY session_id)
SELECT source, session_id, n AS total_messages, CAST(t.s AS BIGINT) AS total_tokens, k AS returned_messages, CAST(g.s AS BIGINT) AS returned_tokens, CAST({BUDGET} AS BIGINT) AS token_budget, 'tail' AS anchor, a AS range_from, b AS range_to, a > 1 AS has_more_before, b < n AS has_more_after, CASE WHEN a > 1 THEN a - 1 END AS cursor_before, CASE WHEN b < n THEN b + 1 END AS cursor_after FROM t JOIN g USING (session_id)""")
def slice_meta(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    return S.slice_meta(S.costed(m), S.slice_sessions(m, BUDGET, "tail"), BUDGET, "tail")


@query("f2_f3_role_and_range", f"""WITH {CONV}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos, count(*) OVER (PARTITION BY session_id) AS k FROM c WHERE role IN ('user', 'assistant')) SELECT session_id, idx, CAST(pos AS INTEGER) AS pos, role FROM f WHERE k >= 2 AND pos >= 2""")
def role_and_range(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    totals = m.groupBy("source", "session_id").agg(F.count("*").alias("total"))
    return S.in_range(S.with_position(S.by_role(m, "user, assistant")), totals, after=2).select("session_id", "idx", "pos", "role")


@query("f3_invalid_ranges", f"""WITH {CONV} SELECT source, session_id, 1 AS first, 5 AS last, count(*) AS total FROM c GROUP BY source, session_id HAVING count(*) < 5""")
def invalid(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    totals = m.groupBy("source", "session_id").agg(F.count("*").alias("total"))
    return S.invalid_ranges(S.with_position(m), totals, first=1, last=5)


PAGES = f"""RECURSIVE {CONV}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos FROM c),
pg AS (SELECT session_id, idx, role, cost, pos, cost AS filled, CAST(1 AS BIGINT) AS page FROM p WHERE pos = 1 UNION ALL
  SELECT p.session_id, p.idx, p.role, p.cost, p.pos, CASE WHEN pg.filled + p.cost > {BUDGET} THEN p.cost ELSE pg.filled + p.cost END, CASE WHEN pg.filled + p.cost > {BUDGET} THEN pg.page + 1 ELSE pg.page END FROM pg JOIN p ON p.session_id = pg.session_id AND p.pos = pg.pos + 1)"""


@query("w7_pages", f"WITH {PAGES} SELECT session_id, idx, page FROM pg")
def pages(spark, sf_dir):
    return S.assign_pages(S.costed(V.conversation_messages(spark, sf_dir)), BUDGET).select("session_id", "idx", "page")


@query("w8_page_read", f"""WITH {PAGES}, tot AS (SELECT session_id, max(page) AS pages FROM pg GROUP BY session_id), chosen AS (SELECT pg.*, pages FROM pg JOIN tot USING (session_id) WHERE page = least(2, pages)),
{trimmed('x AS (SELECT 1)')[len('x AS (SELECT 1), '):]}, t AS (SELECT session_id, source, count(*) AS n, sum(cost) AS s FROM c GROUP BY session_id, source), g AS (SELECT session_id, count(*) AS k, sum(cost) AS s, min(idx) AS a, max(idx) AS b, max(page) AS page, max(pages) AS pages FROM cut GROUP BY session_id)
SELECT source, session_id, n AS total_messages, CAST(t.s AS BIGINT) AS total_tokens, k AS returned_messages, CAST(g.s AS BIGINT) AS returned_tokens, CAST({BUDGET} AS BIGINT) AS token_budget, a AS range_from, b AS range_to, page, pages, page > 1 AS has_more_before, page < pages AS has_more_after, CASE WHEN page > 1 THEN a - 1 END AS cursor_before, CASE WHEN page < pages THEN b + 1 END AS cursor_after FROM t JOIN g USING (session_id)""")
def page_read(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    return S.page_meta(S.costed(m), S.read_page(m, 2, BUDGET), BUDGET)


#: The spoken messages of each session from their second on, with what the smallest preset shows of them as cost.
SPOKEN = CONV.replace("c AS (", "c0 AS (", 1) + """, f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS place, count(*) OVER (PARTITION BY session_id) AS places FROM c0 WHERE role IN ('user', 'assistant')),
c AS (SELECT conv_id, session_id, idx, role, text, 4 + CAST(ceil(least(length(text), 80) / 4.0) AS BIGINT) AS cost, cost AS whole, source, ts FROM f WHERE place >= {first} AND places >= {first})"""


@query("e3_read_search", f"WITH {trimmed(SEARCH.replace(CONV, SPOKEN.format(first=2)).replace(str(BUDGET), '60'))} SELECT session_id, idx, role, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS content FROM cut")
def read_search(spark, sf_dir):
    got = reading.read_sessions(V.conversation_messages(spark, sf_dir), roles="user, assistant", after=2, query=WORD, budget=60, detail="skeleton")
    return got.messages.select("session_id", "idx", "role", "content")


@query("e3_read_page", f"""WITH {PAGES.replace(CONV, SPOKEN.format(first=1)).replace(str(BUDGET), '60')}, tot AS (SELECT session_id, max(page) AS pages FROM pg GROUP BY session_id), chosen AS (SELECT pg.*, pages FROM pg JOIN tot USING (session_id) WHERE page = least(2, pages)),
{trimmed('x AS (SELECT 1)')[len('x AS (SELECT 1), '):]}, t AS (SELECT session_id, source, count(*) AS n, sum(whole) AS s FROM c GROUP BY session_id, source), g AS (SELECT session_id, count(*) AS k, sum(cost) AS s, min(idx) AS a, max(idx) AS b, max(page) AS page, max(pages) AS pages FROM cut GROUP BY session_id)
SELECT source, session_id, n AS total_messages, CAST(t.s AS BIGINT) AS total_tokens, k AS returned_messages, CAST(g.s AS BIGINT) AS returned_tokens, CAST(60 AS BIGINT) AS token_budget, a AS range_from, b AS range_to, page, pages, page > 1 AS has_more_before, page < pages AS has_more_after, CASE WHEN page > 1 THEN a - 1 END AS cursor_before, CASE WHEN page < pages THEN b + 1 END AS cursor_after FROM t JOIN g USING (session_id)""")
def read_second_page(spark, sf_dir):
    return reading.read_sessions(V.conversation_messages(spark, sf_dir), roles="user,assistant", page=2, budget=60, preset="minimal").meta


@query("a10_page_count", f"WITH {CONV} SELECT session_id, CAST(greatest(1, ceil(sum(cost) / {BUDGET}.0)) AS BIGINT) AS pages FROM c GROUP BY session_id")
def page_counts(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    t = A.session_tokens(m).join(A.role_counts(m), ["source", "session_id"])
    return t.select("session_id", S.page_count("tokens", "total_messages", BUDGET).alias("pages"))


@query("f7_skeleton", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS idx, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS content FROM conversations")
def skeleton(spark, sf_dir):
    return S.project_detail(V.conversation_messages(spark, sf_dir), "skeleton").select("session_id", "idx", "content")


@query("a12_detail_hint", f"""WITH {TOOL}, b AS (SELECT session_id, CASE WHEN length(output) > 80 THEN 1 ELSE 0 END AS t, 4 + CAST(ceil(length(name) / 4.0) AS BIGINT) + 4 AS base, {ARGS} AS la, length(output) AS lo FROM e),
s AS (SELECT session_id, sum(t) AS t, sum(base + ceil(least(la, 200) / 4.0) + ceil(least(lo, 500) / 4.0)) AS v, sum(base + ceil(la / 4.0) + ceil(lo / 4.0)) AS f FROM b GROUP BY session_id)
SELECT 'claude' AS source, session_id, 'standard' AS current_preset, CAST(0 AS BIGINT) AS hidden_tool_calls, CAST(t AS BIGINT) AS truncated_results, false AS thinking_hidden, CAST(greatest(floor(v / 100 + 0.5) * 100, 100) AS BIGINT) AS verbose_tokens, CAST(greatest(floor(f / 100 + 0.5) * 100, 100) AS BIGINT) AS full_tokens FROM s WHERE t > 0""")
def detail_hint(spark, sf_dir):
    return S.detail_hint(V.tool_messages(spark, sf_dir), "standard")


@query("p4_p7_text_scalars", r"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
  nullif(substr(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 120), '') AS prompt,
  CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS cut,
  CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 300 THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 300) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS line,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary, false AS injected FROM documents""")
def text_scalars(spark, sf_dir):
    t = F.col("text")
    return V.table(spark, sf_dir, "documents").select("doc_id", P.estimate_tokens(t).alias("tokens"), P.clean_prompt(t).alias("prompt"), P.truncate(t, 80).alias("cut"), P.truncate_single_line(t, 300).alias("line"), P.summarize(t).alias("summary"), (P.is_system_injected(t) | P.is_bootstrap(t)).alias("injected"))


@query("p19_p20_message_tokens", f"""WITH {TOOL} SELECT event_id, 4 + CAST(ceil(length(name) / 4.0) + ceil({ARGS} / 4.0) AS BIGINT) AS use_tokens, 4 + CAST(ceil(length(output) / 4.0) AS BIGINT) AS result_tokens,
  4 + CAST(ceil(length(name) / 4.0) + ceil(least({ARGS}, 60) / 4.0) AS BIGINT) AS use_standard, 4 + CAST(ceil(least(length(output), 80) / 4.0) AS BIGINT) AS result_standard, 4 + CAST(ceil(length(name) / 4.0) AS BIGINT) AS use_minimal, CAST(4 AS BIGINT) AS result_minimal FROM e""")
def message_tokens(spark, sf_dir):
    m = V.tool_messages(spark, sf_dir)
    e = V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.row_number().over(V.Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("raw_line_index"))
    costs = m.select("session_id", "raw_line_index", "role", P.message_tokens("blocks").alias("full"), *[P.message_tokens("blocks", PRESETS[p]).alias(p) for p in ("standard", "minimal")])
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    sums = costs.groupBy("session_id", "raw_line_index").agg(*[pick(r, c).alias(n) for r, c, n in (("tool_use", "full", "use_tokens"), ("tool_result", "full", "result_tokens"), ("tool_use", "standard", "use_standard"), ("tool_result", "standard", "result_standard"), ("tool_use", "minimal", "use_minimal"), ("tool_result", "minimal", "result_minimal"))])
    return e.join(sums, ["session_id", "raw_line_index"]).drop("session_id", "raw_line_index")


@query("p22_transcripts", f"""WITH {CONV} SELECT session_id, string_agg('## #' || idx || ' ' || role || chr(10) || CASE WHEN trim(text) = '' THEN '[empty]' WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 497) || '...' END, chr(10) || chr(10) ORDER BY idx) AS transcript FROM c GROUP BY session_id""")
def transcripts(spark, sf_dir):
    return render.render_transcripts(V.conversation_messages(spark, sf_dir), "standard").select("session_id", "transcript")


@query("a1_role_counts", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system, CAST(0 AS BIGINT) AS n_tool_use, CAST(0 AS BIGINT) AS n_tool_result FROM conversations GROUP BY conv_id")
def role_counts(spark, sf_dir):
    return A.role_counts(V.conversation_messages(spark, sf_dir)).drop("source")


@query("a2_block_types", "SELECT CAST(user_id AS VARCHAR) AS session_id, t AS type, count(*) AS n FROM events, (VALUES ('tool_use'), ('tool_result')) v(t) GROUP BY user_id, t")
def block_types(spark, sf_dir):
    return A.block_types(V.tool_messages(spark, sf_dir)).drop("source")


LAST_NAME = f"{TOOL}, nm AS (SELECT session_id, call, arg_max(name, n) AS name FROM e GROUP BY session_id, call), er AS (SELECT session_id, call, count(*) AS k FROM e WHERE failed GROUP BY session_id, call), err AS (SELECT er.session_id, name, sum(k) AS errors FROM er JOIN nm USING (session_id, call) GROUP BY er.session_id, name), cnt AS (SELECT session_id, name, count(*) AS k, min(n) AS first FROM e GROUP BY session_id, name)"


@query("a3_j1_tool_counts", f"WITH {LAST_NAME} SELECT cnt.session_id, cnt.name, cnt.k AS count, CAST(coalesce(errors, 0) AS BIGINT) AS errors FROM cnt LEFT JOIN err ON err.session_id = cnt.session_id AND err.name = cnt.name")
def tool_counts(spark, sf_dir):
    return A.tool_counts(V.tool_messages(spark, sf_dir)).select("session_id", "name", "count", "errors")


@query("a3_tool_frequency", f"WITH {LAST_NAME} SELECT cnt.session_id, string_agg(cnt.name || '=' || cnt.k || '/' || coalesce(CAST(errors AS BIGINT), 0), ' ' ORDER BY cnt.k DESC, first) AS tools FROM cnt LEFT JOIN err ON err.session_id = cnt.session_id AND err.name = cnt.name GROUP BY cnt.session_id")
def tool_frequency(spark, sf_dir):
    told = F.transform("tool_frequency", lambda t: F.concat(t["name"], F.lit("="), t["count"].cast("string"), F.lit("/"), t["errors"].cast("string")))
    return A.tool_frequency(V.tool_messages(spark, sf_dir)).select("session_id", F.array_join(told, " ").alias("tools"))


@query("j2_as_of_errors", f"WITH {TOOL} SELECT session_id, name, count(*) AS errors FROM e WHERE failed GROUP BY session_id, name")
def as_of_errors(spark, sf_dir):
    return A.attributed_errors_as_of(V.tool_messages(spark, sf_dir, "codex")).drop("source")


@query("j2_late_results", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'click' THEN 'Edit' ELSE event_type END AS name, event_id % 3 AS call, event_type = 'error' AS failed FROM events),
r AS (SELECT f.user_id, f.n, max(u.n) AS m FROM e f JOIN e u ON u.user_id = f.user_id AND u.call = f.call AND u.n <= f.n + 2 WHERE f.failed GROUP BY f.user_id, f.n)
SELECT CAST(r.user_id AS VARCHAR) AS session_id, e.name, count(*) AS errors FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.m GROUP BY r.user_id, e.name""")
def late_errors(spark, sf_dir):
    """Call ids repeat every third event, and a result comes after the two calls that follow its own."""
    return A.attributed_errors_as_of(V.tool_messages(spark, sf_dir, "codex", ids=3, late=2)).drop("source")


@query("e4_j2_goose_tools", """WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN 'Edit' ELSE event_type END AS name FROM events) SELECT CAST(user_id AS VARCHAR) AS session_id, name, count(*) AS count, count(*) FILTER (WHERE event_type = 'error') AS errors FROM e GROUP BY user_id, name""")
def goose_tools(spark, sf_dir):
    """Call ids restart in every line of four calls, so each id is that of many tools."""
    stats = A.session_stats(V.tool_messages(spark, sf_dir, "goose", line=4))
    return stats.select("session_id", F.explode("tool_frequency").alias("t")).select("session_id", "t.name", "t.count", "t.errors")


@query("e4_mixed_sources", """WITH d AS (SELECT user_id, nullif(epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000, 0) AS ms, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN event_type = 'click' THEN '/f/' || json_extract_string(props, '$.k') END)), ','), '') AS files FROM events GROUP BY user_id)
SELECT source, CAST(user_id AS VARCHAR) AS session_id, coalesce(CASE WHEN source = 'codex' THEN CASE WHEN user_id % 2 = 0 THEN user_id END ELSE ms END, -1) AS duration_ms, CASE source WHEN 'claude' THEN files WHEN 'codex' THEN 'p.py,a.py' ELSE '' END AS files FROM d, (VALUES ('claude'), ('codex'), ('kiro')) v(source)""")
def mixed_stats(spark, sf_dir):
    """One source tells durations and files itself; the others' are told by their messages, or none."""
    m = V.tool_messages(spark, sf_dir).unionByName(V.tool_messages(spark, sf_dir, "codex")).unionByName(V.tool_messages(spark, sf_dir, "kiro"))
    own = V.table(spark, sf_dir, "events").select(F.lit("codex").alias("source"), F.col("user_id").cast("string").alias("session_id"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("duration_ms")).distinct()
    files = own.select("source", "session_id", F.array(F.lit("p.py"), F.lit("a.py")).alias("files_modified"))
    return A.session_stats(m, None, own, files).select("source", "session_id", F.coalesce("duration_ms", F.lit(-1).cast("bigint")).alias("duration_ms"), F.array_join("files_modified", ",").alias("files"))


@query("a4_corpus_tools", f"WITH {LAST_NAME} SELECT cnt.name, CAST(sum(cnt.k) AS BIGINT) AS count, CAST(sum(coalesce(errors, 0)) AS BIGINT) AS errors, count(*) AS sessions FROM cnt LEFT JOIN err ON err.session_id = cnt.session_id AND err.name = cnt.name GROUP BY cnt.name")
def corpus_tools(spark, sf_dir):
    return A.corpus_tool_frequency(V.tool_messages(spark, sf_dir))


DELTAS = """k AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER w AS line_no, sum(event_id % 100) OVER w AS i, sum(event_id % 30) OVER w AS c, sum(event_id % 50) OVER w AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, line_no % 3 <> 0 AS has, line_no % 7 = 0 AS own FROM k),
pv AS (SELECT *, last_value(CASE WHEN has THEN i END IGNORE NULLS) OVER w AS pi, last_value(CASE WHEN has THEN c END IGNORE NULLS) OVER w AS pc, last_value(CASE WHEN has THEN o END IGNORE NULLS) OVER w AS po FROM t WINDOW w AS (PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT session_id, line_no, CASE WHEN own THEN line_no % 90 ELSE greatest(i - coalesce(pi, 0), 0) END AS i, CASE WHEN own THEN line_no % 11 ELSE greatest(c - coalesce(pc, 0), 0) END AS c, CASE WHEN own THEN line_no % 5 ELSE greatest(o - coalesce(po, 0), 0) END AS o FROM pv WHERE own OR has),
d AS (SELECT session_id, line_no, CAST(greatest(i - least(c, i), 0) AS BIGINT) AS input, CAST(o AS BIGINT) AS output, CAST(least(c, i) AS BIGINT) AS cache_read FROM r WHERE NOT (greatest(i - least(c, i), 0) = 0 AND o = 0 AND least(c, i) = 0))"""


@query("w6_token_deltas", f"WITH {DELTAS} SELECT session_id, CAST(line_no AS INTEGER) AS line_no, input, output, cache_read FROM d")
def token_deltas(spark, sf_dir):
    return A.usage_deltas(V.counters(spark, sf_dir)).drop("source")


@query("a5_a6_token_usage", f"WITH {DELTAS} SELECT session_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, nullif(CAST(sum(cache_read) AS BIGINT), 0) AS cache_read FROM d GROUP BY session_id")
def token_usage(spark, sf_dir):
    u = A.usage_deltas(V.counters(spark, sf_dir)).withColumn("cache_creation", F.lit(0).cast("bigint"))
    return A.token_usage(u).select("session_id", "token_usage.input", "token_usage.output", "token_usage.cache_read")


@query("a7_files_modified", f"WITH {TOOL} SELECT session_id, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM e WHERE name = 'Edit' GROUP BY session_id")
def files_modified(spark, sf_dir):
    return A.files_modified(V.tool_messages(spark, sf_dir)).select("session_id", F.array_join("files_modified", ",").alias("files"))


@query("a8_durations", "SELECT CAST(user_id AS VARCHAR) AS session_id, nullif(epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000, 0) AS duration_ms FROM events GROUP BY user_id")
def durations(spark, sf_dir):
    return A.durations(V.tool_messages(spark, sf_dir)).drop("source")


@query("a15_session_info", f"""WITH {CONV}, s AS (SELECT source, session_id, count(*) AS n, sum(cost) AS t, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a, count(*) FILTER (WHERE role = 'system') AS y FROM c GROUP BY source, session_id)
SELECT source, session_id, n AS total_messages, CAST(t AS BIGINT) AS total_tokens, CAST(greatest(1, ceil(t / 4000.0)) AS BIGINT) AS pages, CASE WHEN n >= 2 THEN CAST(n - 1 AS VARCHAR) || 'm 0s' END AS duration, round(u * 100.0 / n, 1) AS pct_user, round(a * 100.0 / n, 1) AS pct_assistant, round(y * 100.0 / n, 1) AS pct_system FROM s""")
def session_info(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    return A.session_info(A.session_stats(m), A.session_tokens(m)).select("source", "session_id", "total_messages", "total_tokens", "pages", "duration", "pct_user", "pct_assistant", "pct_system")


@query("a13_active_files", f"WITH {TOOL}, f AS (SELECT session_id, file, min(n) AS first FROM e GROUP BY session_id, file), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS q FROM f) SELECT session_id, string_agg(file, ',' ORDER BY q) AS files FROM r WHERE q <= 50 GROUP BY session_id")
def active_files(spark, sf_dir):
    return context.active_files(V.tool_messages(spark, sf_dir)).select("session_id", F.array_join("active_files", ",").alias("files"))


@query("e6_context", f"""WITH {trimmed(chosen('idx DESC').replace('FROM conversations)', "FROM conversations WHERE role <> 'system')"))}, g AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS token_count_estimate, string_agg(role || ': ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10) ORDER BY idx) AS told FROM cut GROUP BY session_id),
every AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, substr(arg_max(text, turn) FILTER (WHERE role = 'user'), 1, 500) AS current_task FROM conversations GROUP BY conv_id)
SELECT session_id, coalesce(token_count_estimate, 0) AS token_count_estimate, told, current_task FROM every LEFT JOIN g USING (session_id)""")
def export_context(spark, sf_dir):
    out = context.export_context(V.conversation_messages(spark, sf_dir), BUDGET, format="summary")
    told = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["summary"])), "\n")
    return out.select("session_id", "token_count_estimate", told.alias("told"), "current_task")


@query("a11_match_counts", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS matches FROM conversations WHERE contains(lower(text), 'ing') GROUP BY conv_id")
def match_counts(spark, sf_dir):
    return A.match_counts(V.conversation_messages(spark, sf_dir), "ING").drop("source")


@query("w10_dedup_index", f"WITH {INDEX} SELECT * FROM dedup")
def dedup_index(spark, sf_dir):
    return C.dedup_index(V.session_index(spark, sf_dir))


@query("t1_j9_list", f"""WITH {INDEX}, hit AS (SELECT DISTINCT source, session_id FROM c WHERE contains(lower(text), 'ing')), ok AS (SELECT dedup.* FROM dedup JOIN hit ON hit.source = dedup.source AND hit.session_id = dedup.id), tot AS (SELECT count(*) AS total_available FROM ok)
SELECT ok.*, total_available, 30 < total_available AS has_more FROM ok, tot ORDER BY updated_at DESC, id LIMIT 20 OFFSET 10""")
def listed(spark, sf_dir):
    return C.list_sessions(V.session_index(spark, sf_dir), V.conversation_messages(spark, sf_dir), "ing", limit=20, offset=10)


@query("t2_search_top", f"WITH {INDEX}, m AS (SELECT source, session_id AS id, count(*) AS matches FROM c WHERE contains(lower(text), 'ing') GROUP BY source, session_id) SELECT dedup.*, matches FROM dedup JOIN m USING (source, id) ORDER BY matches DESC, updated_at DESC, id LIMIT 10")
def search_top(spark, sf_dir):
    return C.search_sessions(V.session_index(spark, sf_dir), V.conversation_messages(spark, sf_dir), "ing")


@query("j5_resolve", f"""WITH {INDEX}, q AS (SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) WHEN conv_id % 3 = 1 THEN substr(CAST(conv_id AS VARCHAR), 1, 1) ELSE 'x' || CAST(conv_id AS VARCHAR) END AS request FROM conversations),
m AS (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY (id = request) DESC, updated_at DESC, id) AS r FROM q JOIN dedup ON starts_with(id, request)) SELECT request, id FROM m WHERE r = 1""")
def resolve(spark, sf_dir):
    return C.resolve_ids(V.session_index(spark, sf_dir), _requests(spark, sf_dir)).select("request", "id")


def _requests(spark, sf_dir):
    c = F.col("conv_id")
    return V.table(spark, sf_dir, "conversations").select(F.when(c % 3 == 0, c.cast("string")).when(c % 3 == 1, F.substring(c.cast("string"), 1, 1)).otherwise(F.concat(F.lit("x"), c.cast("string"))).alias("request"))


@query("j5_unresolved", "SELECT DISTINCT 'x' || CAST(conv_id AS VARCHAR) AS request FROM conversations WHERE conv_id % 3 = 2")
def unresolved(spark, sf_dir):
    wanted = _requests(spark, sf_dir)
    return C.unresolved(wanted, C.resolve_ids(V.session_index(spark, sf_dir), wanted))


@query("w12_latest_in_cwd", f"""WITH {INDEX}, h AS (SELECT source, cwd, id, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, id) AS r FROM ix), top AS (SELECT source, id FROM h WHERE r = 1), mine AS (SELECT source, cwd, arg_min(id, r) AS id FROM h WHERE r <= 5 GROUP BY source, cwd), asked AS (SELECT DISTINCT source, cwd FROM ix)
SELECT asked.source, asked.cwd, coalesce(mine.id, top.id) AS id FROM asked LEFT JOIN mine ON mine.source = asked.source AND mine.cwd = asked.cwd JOIN top ON top.source = asked.source""")
def latest(spark, sf_dir):
    return C.latest_in_cwd(V.session_index(spark, sf_dir))


@query("f5_prune", f"WITH {INDEX} SELECT id, updated_at FROM dedup WHERE updated_at < TIMESTAMP '2026-01-10 00:00:00' - INTERVAL 7 DAY")
def prune(spark, sf_dir):
    return C.prune_candidates(V.session_index(spark, sf_dir), "7d", F.lit("2026-01-10 00:00:00").cast("timestamp")).select("id", "updated_at")


@query("u3_j10_tags", f"""WITH {INDEX}, t AS (SELECT CAST(conv_id AS VARCHAR) AS id, role AS tag, 0 AS turn FROM conversations UNION SELECT CAST(user_id AS VARCHAR), event_type, 1 FROM events), k AS (SELECT * FROM t WHERE tag <> 'system'), g AS (SELECT id, string_agg(tag, ',' ORDER BY turn, tag) AS tags FROM k GROUP BY id)
SELECT dedup.id, source, coalesce(tags, '') AS tags FROM dedup LEFT JOIN g ON g.id = dedup.id""")
def tags(spark, sf_dir):
    tag = lambda t, i, c: V.table(spark, sf_dir, t).select(F.col(i).cast("string").alias("session_id"), F.col(c).alias("tag"))
    spoken = tag("conversations", "conv_id", "role")
    held = C.apply_tags(spoken, add=tag("events", "user_id", "event_type"), remove=spoken.where("tag = 'system'"))
    return C.with_tags(C.dedup_index(V.session_index(spark, sf_dir)), held).select("id", "source", F.array_join("tags", ",").alias("tags"))


@query("j6_diff", f"""WITH {TOOL}, t AS (SELECT session_id, list(DISTINCT name) AS tools, list(DISTINCT file) FILTER (WHERE name = 'Edit') AS files FROM e GROUP BY session_id), p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS a, CAST(user_id + 1 AS VARCHAR) AS b FROM events)
SELECT a, b, array_to_string(list_sort(list_filter(x.tools, lambda v: NOT list_contains(y.tools, v))), ',') AS tools_a, array_to_string(list_sort(list_intersect(x.tools, y.tools)), ',') AS tools_both, CAST(len(list_filter(coalesce(x.files, []), lambda v: NOT list_contains(coalesce(y.files, []), v))) AS BIGINT) AS files_a, CAST(len(list_intersect(coalesce(x.files, []), coalesce(y.files, []))) AS BIGINT) AS files_both FROM p JOIN t x ON x.session_id = a JOIN t y ON y.session_id = b""")
def diff(spark, sf_dir):
    stats = A.session_stats(V.tool_messages(spark, sf_dir))
    pairs = V.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("a"), (F.col("user_id") + 1).cast("string").alias("b")).distinct()
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return D.diff_sessions(pairs, stats).select("a", "b", join("tools_only_a").alias("tools_a"), join("tools_both").alias("tools_both"), F.size("files_only_a").cast("bigint").alias("files_a"), F.size("files_both").cast("bigint").alias("files_both"))


@query("j7_new_messages", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn + 1 AS INTEGER) AS idx FROM conversations WHERE turn >= 4 OR conv_id % 5 = 0")
def new_messages(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    old = m.where((F.col("idx") <= 4) & (F.col("session_id").cast("bigint") % 5 != 0)).groupBy("source", "session_id").agg(F.count("*").alias("n_before"))
    return D.new_messages(m, old).select("session_id", "idx")


@query("j8_changed_sessions", f"""WITH {CONV}, now AS (SELECT source, session_id, substr(md5(strftime(max(ts), '%Y-%m-%dT%H:%M:%S.000Z') || ':' || count(*)), 1, 16) AS etag, max(idx) AS top FROM c GROUP BY source, session_id) SELECT source, session_id, etag FROM now WHERE top > 4""")
def changed(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    def tagged(rows):
        s = rows.groupBy("source", "session_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("total_messages"))
        return D.etags(s, s)
    return D.changed_sessions(tagged(m), tagged(m.where("idx <= 4")))


@query("s7_jsonl_lines", f"""WITH {CONV} SELECT session_id, idx AS line_no, '{{"type":"message","index":' || idx || ',"role":"' || role || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","tokens_estimate":' || cost || ',' AS head FROM c UNION ALL SELECT DISTINCT session_id, 0, '{{"type":"meta","source":"' || source || '","session_id":"' || session_id || '",' FROM c""")
def jsonl(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    meta = S.slice_meta(S.costed(m), S.slice_sessions(m, BUDGET, "head"), BUDGET, "head")
    lines = render.jsonl_lines(m, meta)
    head = F.when(F.col("line_no") == 0, F.substring_index("value", '"total_messages"', 1)).otherwise(F.substring_index("value", '"content"', 1))
    return lines.select("session_id", "line_no", head.alias("head"))


@query("s8_envelopes", f"""WITH {CONV} SELECT session_id, true AS is_json, count(*) AS messages, CAST(sum(cost) AS BIGINT) AS tokens FROM c GROUP BY session_id""")
def envelopes(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    meta = S.slice_meta(S.costed(m), S.slice_sessions(m, BUDGET, "head"), BUDGET, "head")
    v = F.try_parse_json("json")
    parts = F.try_variant_get(v, "$.messages", "array<variant>")
    return render.envelopes(m, meta).select("session_id", v.isNotNull().alias("is_json"), F.size(parts).cast("bigint").alias("messages"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n + F.try_variant_get(x, "$.tokens_estimate", "bigint")).alias("tokens"))


#: JSON of each session's meta row about its slice from the head, and of each message up to its blocks.
WRITTEN = f"""{trimmed(chosen('idx'))}, tot AS (SELECT session_id, source, count(*) AS n, CAST(sum(cost) AS BIGINT) AS s FROM c GROUP BY session_id, source), got AS (SELECT session_id, count(*) AS k, CAST(sum(cost) AS BIGINT) AS s, min(idx) AS a, max(idx) AS b FROM cut GROUP BY session_id),
meta AS (SELECT session_id, '"source":"' || source || '","session_id":"' || session_id || '","total_messages":' || n || ',"total_tokens":' || tot.s || ',"returned_messages":' || k || ',"returned_tokens":' || got.s || ',"token_budget":{BUDGET},"anchor":"head","range_from":' || a || ',"range_to":' || b || ',"has_more_before":' || (a > 1) || ',"has_more_after":' || (b < n)
  || CASE WHEN a > 1 THEN ',"cursor_before":' || (a - 1) ELSE '' END || CASE WHEN b < n THEN ',"cursor_after":' || (b + 1) ELSE '' END || '}}' AS meta FROM tot JOIN got USING (session_id)),
said AS (SELECT session_id, idx, '"index":' || idx || ',"role":"' || role || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","tokens_estimate":' || cost || ',"content":' || CAST(to_json(text) AS VARCHAR) AS told, CAST(to_json(text) AS VARCHAR) AS q FROM c)"""


@query("s7_whole_lines", f"""WITH {WRITTEN} SELECT session_id, idx AS line_no, md5('{{"type":"message",' || told || ',"blocks":[{{"type":"text","text":' || q || '}}]}}') AS value_md5 FROM said UNION ALL SELECT session_id, 0, md5('{{"type":"meta",' || meta) FROM meta""")
def whole_lines(spark, sf_dir):
    """Lines as they are written, and read back from their files."""
    m = V.conversation_messages(spark, sf_dir)
    meta = S.slice_meta(S.costed(m), S.slice_sessions(m, BUDGET, "head"), BUDGET, "head")
    at = new_path(spark, "jsonl")
    writers.write_jsonl(m, meta, at)
    value = F.try_parse_json("value")
    own = F.coalesce(P.text_at(value, "$.session_id"), F.lit(""))
    read = spark.read.text(at).select("value", own.alias("own"), F.coalesce(P.long_at(value, "$.index"), F.lit(0)).cast("int").alias("line_no"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # a session's lines stand together, behind its meta record
    session = F.last(F.nullif("own", F.lit("")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    return read.select(session.alias("session_id"), "line_no", F.md5(F.col("value").cast("binary")).alias("value_md5"))


@query("s8_whole_envelopes", f"""WITH {WRITTEN} SELECT session_id, md5('{{"api_version":1,"meta":{{' || any_value(meta) || ',"messages":[' || string_agg('{{' || told || '}}', ',' ORDER BY idx) || ']}}') AS json_md5 FROM said JOIN meta USING (session_id) GROUP BY session_id""")
def whole_envelopes(spark, sf_dir):
    m = V.conversation_messages(spark, sf_dir)
    meta = S.slice_meta(S.costed(m), S.slice_sessions(m, BUDGET, "head"), BUDGET, "head")
    return render.envelopes(m, meta).select("session_id", F.md5(F.col("json").cast("binary")).alias("json_md5"))
