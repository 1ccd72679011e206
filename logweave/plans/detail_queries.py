"""Queries of single projections, snapshot choices, sidecars and the tool calls of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as P
from ..functions.presets import preset
from ..functions.schemas import BLOCKS
from ..operators import catalog as C
from ..operators import explode as X
from ..operators import stats as A
from ..sources import claude, documents
from . import views as V
from .ingest_queries import _conv, _facts, _json, claude_lines
from .message_queries import INDEX

QUERIES: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f
    return keep


#: White space in SQL, as a class and as the characters to trim.
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _line(e: str) -> str:
    return f"nullif(substr(trim(regexp_replace({e}, '{SPACE}+', ' ', 'g')), 1, 120), '')"


@query("p3_p9_prompt_scalars", f"""WITH s AS (SELECT doc_id, text, ['  # AGENTS.md ', '<identity>', '# ', ''][CAST(doc_id % 4 + 1 AS INTEGER)] || text AS led FROM documents)
SELECT doc_id, coalesce(regexp_matches(led, '^{SPACE}*(<user_instructions>|<environment_context>|<permissions|# AGENTS\\.md)'), false) AS bootstrap, coalesce(regexp_matches(led, '^(<identity>|# )'), false) AS system_prompt,
CASE WHEN doc_id % 3 <> 0 THEN nullif({_trim('text')}, '') END AS request,
{_line("regexp_replace(regexp_replace('<tag>junk</tag> ' || text, '<[^>]+>.*?</[^>]+>', '', 'gs'), '<[^>]+>', '', 'g')")} AS title FROM s""")
def prompt_scalars(spark, sf_dir):
    """Texts behind system prefixes, behind rule blocks and before steering tags, and in titles with tagged parts and rules."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    led = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("  # AGENTS.md ", "<identity>", "# ", "")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")), "text")
    ruled = F.concat(F.lit("a</user-rule> <user-rule>b</user-rule>\n"), "text", F.lit("\n<EnvironmentContext>c</EnvironmentContext> <steering-reminder>d"))
    asked = F.when(F.pmod("doc_id", F.lit(3)) != 0, ruled).otherwise(F.col("text"))
    titled = F.concat(F.lit("<tag>junk</tag> "), "text", F.lit("\n## Included Rules\nmore"))
    return d.select("doc_id", P.is_bootstrap(led).alias("bootstrap"), P.is_system_prompt(led).alias("system_prompt"), P.user_request(asked).alias("request"), P.clean_title(titled).alias("title"))


@query("p13_p17_line_scalars", """SELECT event_id, '/f/' || user_id || ',/g/' || event_id % 3 AS files, CASE WHEN event_id % 4 < 3 THEN 'm' || user_id % 5 END AS model, CAST(event_id AS VARCHAR) AS file_id, '/p/' || user_id AS folder, '/w/' || event_id AS workspace,
CASE WHEN event_id % 3 < 2 THEN date_trunc('milliseconds', CAST(ts AS TIMESTAMP)) END AS at FROM events""")
def line_scalars(spark, sf_dir):
    """Patches, models at three depths, rollout and plain file names, dashed and base64 folders, times as text or number."""
    e = V.table(spark, sf_dir, "events")
    n, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    third = F.pmod("event_id", F.lit(3))
    patch = said("*** Begin Patch\n*** Add File: /f/", user, "\n+x\n*** Update File: /g/", third.cast("string"), "\n-y\n*** Delete  File: /f/", user, " \n*** End Patch")
    name = said("m", F.pmod("user_id", F.lit(5)).cast("string"))
    shape = F.pmod("event_id", F.lit(4))
    held = F.when(shape == 0, said('{"model":"', name, '"}')).when(shape == 1, said('{"model":" ","info":{"model_name":" ', name, ' "}}')).when(shape == 2, said('{"metadata":{"info":{"model":"', name, '"}}}')).otherwise('{"info":{"x":1}}')
    path = F.when(F.pmod("event_id", F.lit(2)) == 0, said("/s/rollout-2026-01-15T10-00-00-", n, ".jsonl")).otherwise(said("/s/", n, ".json"))
    encoded = F.rtrim(F.translate(F.base64(F.encode(said("/w/", n), "UTF-8")), "+/", "-_"), F.lit("="))
    when = F.when(third == 0, F.unix_millis("ts").cast("string")).when(third == 1, said('"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '"')).otherwise('"soon"')
    return e.select("event_id", F.array_join(P.patch_files(patch), ",").alias("files"), P.model_of(F.try_parse_json(held)).alias("model"), P.file_id(path).alias("file_id"), P.decode_path(said("-p-", user)).alias("folder"), P.decode_base64(encoded).alias("workspace"), P.flexible_timestamp(F.try_parse_json(when)).alias("at"))


@query("f1_source_list", f"""WITH {INDEX.replace('FROM ix)', "FROM ix WHERE source = 'codex')")} SELECT id, updated_at, file_path, count(*) OVER () AS total_available FROM dedup""")
def source_list(spark, sf_dir):
    return C.list_sessions(V.session_index(spark, sf_dir), source="codex", limit=None).select("id", "updated_at", "file_path", "total_available")


@query("w11_snapshots", """WITH s AS (SELECT event_id, user_id, event_id % 7 AS k, event_id % 5 = 0 AS alone, '/e/' || event_id AS path FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, path) AS r FROM s WHERE NOT alone)
SELECT event_id, k AS message_count FROM r WHERE r = 1 UNION ALL SELECT event_id, k FROM s WHERE alone""")
def snapshots(spark, sf_dir):
    """Each event is a snapshot of its user's execution; every fifth belongs to none."""
    e = V.table(spark, sf_dir, "events")
    held = F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("user_id").cast("string"))
    rows = e.select("event_id", F.lit("kiro").alias("source"), held.alias("execution_id"), F.pmod("event_id", F.lit(7)).alias("message_count"), F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("file_path"))
    return C.keep_snapshots(rows).select("event_id", "message_count")


@query("w11_first_file", """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN '/a/archived_sessions/' ELSE '/z/sessions/' END || event_id AS file_path, event_id % 2 AS live FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY live DESC, file_path) AS r FROM s) SELECT id, file_path FROM r WHERE r = 1""")
def first_file(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    folder = F.when(F.pmod("event_id", F.lit(2)) == 0, "/a/archived_sessions/").otherwise("/z/sessions/")
    rows = e.select(F.lit("codex").alias("source"), F.col("user_id").cast("string").alias("id"), F.concat(folder, F.col("event_id").cast("string")).alias("file_path"))
    return C.first_file(rows).select("id", "file_path")


@query("t3_block_order", """WITH b AS (SELECT conv_id, 'text' AS type, sum(turn % 3) AS n, min(turn) FILTER (WHERE turn % 3 > 0) AS first FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'thinking', sum((conv_id + turn) % 4), min(turn) FILTER (WHERE (conv_id + turn) % 4 > 0) FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(type || '=' || CAST(n AS BIGINT), ' ' ORDER BY n DESC, first, type) AS blocks FROM b WHERE n > 0 GROUP BY conv_id""")
def block_order(spark, sf_dir):
    """Messages of up to two text blocks and up to three thinking blocks."""
    m = V.conversation_messages(spark, sf_dir)
    turn = F.col("idx") - 1
    blocks = F.concat(F.array_repeat(X.block("text", text=F.col("content")), F.pmod(turn, F.lit(3)).cast("int")), F.array_repeat(X.block("thinking", text=F.lit("hm")), F.pmod(F.col("session_id").cast("bigint") + turn, F.lit(4)).cast("int")))
    told = F.transform("block_frequency", lambda b: F.concat(b["type"], F.lit("="), b["n"].cast("string")))
    return A.block_frequency(m.withColumn("blocks", blocks.cast(BLOCKS))).select("session_id", F.array_join(told, " ").alias("blocks"))


@query("i12_j3_claude_sidecar", f"""WITH c AS (SELECT conv_id, turn, role = 'user' AS asks, {_line("regexp_replace(text, '<[^>]+>', '', 'g')")} AS prompt FROM conversations WHERE turn * 2 < 30),
g AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE asks AND prompt IS NOT NULL), max(turn)) AS t, arg_min(prompt, turn) FILTER (WHERE asks AND prompt IS NOT NULL) AS prompt FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 2 = 1 THEN '/p/' || conv_id WHEN conv_id % 4 = 0 THEN 'x' ELSE '/side/' || conv_id END AS cwd,
CASE WHEN conv_id % 2 = 1 THEN TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 3600 + t * 60) WHEN conv_id % 6 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE TIMESTAMP '2026-03-01 00:00:00' END AS updated_at,
CASE WHEN conv_id % 2 = 1 THEN prompt WHEN conv_id % 10 <> 0 THEN 'Side prompt ' || conv_id END AS summary FROM g""")
def claude_sidecar(spark, sf_dir):
    """Every second session has a sidecar entry, some without a folder, time or prompt."""
    lines = claude_lines(spark, sf_dir)
    c = _conv(spark, sf_dir).select("conv_id", "sid").distinct().where("conv_id % 2 = 0")
    side = c.select(
        F.col("sid").alias("session_id"),
        F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("/side/"), "sid")).alias("project_path"),
        F.when(F.col("conv_id") % 6 != 0, "2026-03-01T00:00:00Z").alias("modified"),
        F.when(F.col("conv_id") % 10 == 0, "No prompt").otherwise(F.concat(F.lit("Side  <b>prompt\n"), "sid")).alias("first_prompt"),
    )
    return claude.index_claude(lines, _facts(lines), side).select("id", "cwd", "updated_at", "summary")


def gemini_docs(spark, sf_dir):
    """Assistants think, speak, and call a tool whose answer is an output, an error, or an output with a failed state."""
    c = _conv(spark, sf_dir)
    spoken, turn = F.col("role") == "assistant", F.col("turn").cast("string")
    answer = F.struct(F.concat(F.lit("out "), turn).alias("output"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit("boom "), turn)).alias("error"))
    call = F.struct(F.when(F.col("turn") % 5 != 0, F.concat(F.lit("g"), turn)).alias("id"), F.lit("grep").alias("name"), F.when(F.col("turn") % 3 == 0, "error").otherwise("success").alias("status"), F.struct(turn.alias("q")).alias("args"), F.array(F.struct(F.struct(answer.alias("response")).alias("functionResponse"))).alias("result"))
    m = F.struct(
        F.when(spoken, "gemini").when(F.col("role") == "system", "info").otherwise("user").alias("type"),
        F.col("text").alias("content"),
        F.when(spoken, F.array(F.struct(F.lit("hm").alias("subject")))).alias("thoughts"),
        F.when(spoken, F.array(call)).alias("toolCalls"),
        F.when(spoken, F.struct((F.col("turn") + 10).alias("input"), F.col("turn").alias("output"), F.lit(3).alias("cached"))).alias("tokens"),
    )
    packed = c.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"), F.min("at").alias("startTime"))
    return packed.select(F.concat(F.lit("/g/tmp/proj/chats/session-"), "sid", F.lit(".json")).alias("file_path"), F.try_parse_json(_json(sessionId=F.col("sid"), startTime=F.col("startTime"), messages=F.col("messages"))).alias("v"))


@query("i3_gemini_blocks", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, coalesce(text, '') <> '' AS has FROM conversations),
c AS (SELECT *, CASE WHEN turn % 5 <> 0 THEN 'g' || turn ELSE 'gemini-tool-' || place || '-grep' END AS call FROM t),
x AS (SELECT conv_id, turn, 0 AS sub, 0 AS b, 'text' AS type, CASE WHEN role = 'system' THEN '[info] ' || text ELSE text END AS told, NULL AS call, false AS failed FROM c WHERE role <> 'assistant' AND has
UNION ALL SELECT conv_id, turn, 0, 0, 'thinking', 'hm', NULL, false FROM c WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 0, 1, 'text', text, NULL, false FROM c WHERE role = 'assistant' AND has
UNION ALL SELECT conv_id, turn, 1, 0, 'tool_use', 'grep {"q":"' || turn || '"}', call, false FROM c WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 2, 0, 'tool_result', CASE WHEN turn % 4 = 1 THEN 'boom ' ELSE 'out ' END || turn, call, turn % 4 = 1 OR turn % 3 = 0 FROM c WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn, sub) AS INTEGER) AS idx, CAST(b AS INTEGER) AS bpos, type, told, call, failed FROM x""")
def gemini_blocks(spark, sf_dir):
    b = A.exploded(documents.ingest_gemini(gemini_docs(spark, sf_dir)).messages)
    told = F.coalesce("text", F.concat_ws(" ", "name", "input_json"))
    return b.select("session_id", "idx", "bpos", "type", F.when(F.col("type") == "tool_result", F.col("content")).otherwise(told).alias("told"), F.coalesce("id", "tool_use_id").alias("call"), F.coalesce("is_error", F.lit(False)).alias("failed"))


@query("i3_a5_gemini_usage", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(turn + 10) AS BIGINT) AS input, CAST(sum(turn) AS BIGINT) AS output, 3 * count(*) AS cache_read FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def gemini_usage(spark, sf_dir):
    return A.token_usage(documents.ingest_gemini(gemini_docs(spark, sf_dir)).usage).select("session_id", "token_usage.input", "token_usage.output", "token_usage.cache_read")


def _tr(e: str, most: int | None) -> str:
    return e if most is None else f"(CASE WHEN length({e}) <= {most} THEN {e} ELSE substr({e}, 1, {most - 3}) || '...' END)"


def _rendered(content: int | None, args: str, result: str, thought: str) -> str:
    """SQL of a rendered message: its parts that are not blank, by lines."""
    parts = f"[{_tr('said', content)}, {thought}, {args}, {result}]"
    return f"md5('## #' || event_id || ' assistant' || chr(10) || array_to_string(list_filter({parts}, lambda p: trim(p) <> ''), chr(10)))"


RESULT = "(CASE WHEN event_id % 3 = 0 THEN '[ERROR] ' ELSE '' END || {})"
THOUGHT = "('<thinking>' || chr(10) || {} || chr(10) || '</thinking>')"
SHOWN = "('{ file_path: /f/' || event_id || ', n: ' || event_id || ', q: null, z: ' || z || ' }')"


@query("p21_rendered_blocks", f"""WITH e AS (SELECT event_id, 'text ' || repeat('ab', CAST(event_id % 1200 AS INTEGER)) AS said, repeat('t', CAST(150 + event_id % 100 AS INTEGER)) AS thought, repeat('z', CAST(event_id % 250 AS INTEGER)) AS z, repeat('r', CAST(event_id % 700 AS INTEGER)) AS told FROM events)
SELECT event_id, {_rendered(80, "'Edit'", "'[result hidden]'", "''")} AS minimal, {_rendered(500, "'Edit ' || " + _tr(SHOWN, 60), RESULT.format(_tr('told', 80)), "''")} AS standard, {_rendered(2000, "'Edit ' || " + _tr(SHOWN, 200), RESULT.format(_tr('told', 500)), THOUGHT.format(_tr('thought', 200)))} AS verbose,
  {_rendered(None, "'Edit {\"file_path\":\"/f/' || event_id || '\",\"n\":' || event_id || ',\"q\":null,\"z\":\"' || z || '\"}'", RESULT.format('told'), THOUGHT.format('thought'))} AS "full" FROM e""")
def rendered_blocks(spark, sf_dir):
    """A text, a thought, a call and its result in every preset; lengths pass each cap."""
    e = V.table(spark, sf_dir, "events")
    n, many = F.col("event_id"), lambda c, k: F.repeat(F.lit(c), F.pmod(F.col("event_id"), F.lit(k)).cast("int"))
    args = F.concat(F.lit('{"file_path":"/f/'), n.cast("string"), F.lit('","n":'), n.cast("string"), F.lit(',"q":null,"z":"'), many("z", 250), F.lit('"}'))
    blocks = F.array(
        X.block("text", text=F.concat(F.lit("text "), many("ab", 1200))),
        X.block("thinking", text=F.concat(F.repeat(F.lit("t"), 150), many("t", 100))),
        X.block("tool_use", id=F.lit("c"), name=F.lit("Edit"), input_json=args),
        X.block("tool_result", tool_use_id=F.lit("c"), content=many("r", 700), is_error=n % 3 == 0),
    ).cast(BLOCKS)
    rows = e.select("event_id", F.col("event_id").alias("idx"), F.lit("assistant").alias("role"), blocks.alias("blocks"))
    return rows.select("event_id", *[F.md5(P.render_message(preset(p)).cast("binary")).alias(p) for p in ("minimal", "standard", "verbose", "full")])


@query("p1_p10_p11_outputs", """WITH e AS (SELECT event_id, event_id % 8 AS k, CAST(event_id AS VARCHAR) AS i FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'plain ' || i WHEN 1 THEN 'inner ' || i WHEN 2 THEN '{"x":' || i || '}' WHEN 3 THEN '{"a":' || i || '}' WHEN 4 THEN '[{"text":"a' || i || '","type":"text"},{"type":"image"},{"text":"b","type":"text"}]' WHEN 5 THEN i WHEN 6 THEN repeat('x', 500) || '…' ELSE '' END AS preview,
  CASE k WHEN 1 THEN '{"output":"inner ' || i || '"}' WHEN 2 THEN '{"x":' || i || '}' WHEN 3 THEN '{"a":' || i || '}' ELSE '{}' END AS object,
  CASE k WHEN 0 THEN 'plain  ' || i WHEN 1 THEN '{"output":"inner ' || i || '"}' WHEN 2 THEN '{"x":' || i || '}' WHEN 4 THEN 'a' || i || chr(10) || 'b' WHEN 6 THEN repeat('x', 600) WHEN 7 THEN '  ' ELSE '' END AS told FROM e""")
def outputs(spark, sf_dir):
    """Outputs of each kind: text, JSON in text with and without an output, objects, parts, numbers, long and blank texts."""
    i = F.col("event_id").cast("string")
    kinds = [
        F.concat(F.lit('"plain  '), i, F.lit('"')),
        F.concat(F.lit('"{\\"output\\":\\"inner '), i, F.lit('\\"}"')),
        F.concat(F.lit('"{\\"x\\":'), i, F.lit('}"')),
        F.concat(F.lit('{"a":'), i, F.lit("}")),
        F.concat(F.lit('[{"type":"text","text":"a'), i, F.lit('"},{"type":"image"},{"type":"text","text":"b"}]')),
        i,
        F.concat(F.lit('"'), F.repeat(F.lit("x"), 600), F.lit('"')),
        F.lit('"  "'),
    ]
    v = F.try_parse_json(F.element_at(F.array(*kinds), (F.pmod("event_id", F.lit(8)) + 1).cast("int")))
    rows = V.table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return rows.select("event_id", P.preview_output(F.col("v")).alias("preview"), P.object_or_empty(F.col("v")).alias("object"), P.tool_result_text(F.col("v")).alias("told"))


@query("p23_texts", """WITH e AS (SELECT event_id, event_id * event_id * 37 AS n, event_id * 977 % 5000000 AS ago FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', ((n * 10 + 512) // 1024) / 10.0) || ' KB' ELSE printf('%.1f', ((n * 10 + 524288) // 1048576) / 10.0) || ' MB' END AS size,
  CASE WHEN ago < 60 THEN 'just now' WHEN ago < 3600 THEN ago // 60 || 'm ago' WHEN ago < 86400 THEN ago // 3600 || 'h ago' WHEN ago < 172800 THEN 'yesterday' WHEN ago < 2592000 THEN ago // 86400 || 'd ago' ELSE strftime(TIMESTAMP '2026-03-01 00:00:00' - to_seconds(ago), '%Y-%m-%d') END AS age,
  CASE WHEN event_id % 2 = 0 THEN '~/p/' || event_id ELSE '/srv/p/' || event_id END AS path, CASE WHEN ago < 60 THEN ago || 's' WHEN ago < 3600 THEN ago // 60 || 'm ' || ago % 60 || 's' ELSE ago // 3600 || 'h ' || ago // 60 % 60 || 'm' END AS duration FROM e""")
def texts(spark, sf_dir):
    """Sizes, ages, folders and durations of every unit."""
    n, now = F.col("event_id"), F.lit("2026-03-01 00:00:00").cast("timestamp")
    rows = V.table(spark, sf_dir, "events").select("event_id", (n * n * 37).alias("n"), (n * 977 % 5000000).alias("ago"), F.concat(F.when(n % 2 == 0, "/home/u").otherwise("/srv"), F.lit("/p/"), n.cast("string")).alias("path"))
    when = F.timestamp_seconds(F.unix_timestamp(now) - F.col("ago"))
    return rows.select("event_id", P.bytes_text("n").alias("size"), P.relative_time(when, now).alias("age"), P.shorten_home("path", "/home/u").alias("path"), P.duration_text(F.col("ago") * 1000).alias("duration"))
