"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its parts between white space; a token with a digit is a variable field, ``<*>``. The tree has a
fixed depth: token count, then the first LEADING tokens; under them lies a leaf. In a leaf a token is fixed at its
position if lines of enough documents have it there; other tokens are variable too. A line whose fixed tokens make up at least SIMILAR percent of it gets the generalised template, any other
line its own tokens. Lines of a template that enough documents hold are recurring and are dropped
from all documents; the rest keep their order. Enough are MIN_DOCS documents, and LONG_DOCS for lines of more than LONG_TOKENS
tokens, which no two documents share by chance. Documents with equal texts count as one: copies of a document
are no recurrence of its lines.

Texts are read three times and shuffled once, at the end. The first reading leaves a table of line numbers and
hashes (a leaf's hash and a line's hash stand for a line), on which lines and leaves are counted. The second
fetches the texts of lines whose leaf has enough lines: a bit filter of bounded size, made from those leaves, is
sent to the tasks, so nearly all other lines stay where they are; what it lets through wrongly goes in the exact
join after it. Tokens are counted by hash, and again only those that a bit filter of the fixed ones passes are joined. The third
reading joins the places of recurring lines to their documents. Counts are summed before they are shuffled: a line that
a third of all documents hold is one key with one number. The sum over the lines of a group is a bound of its documents, and
its most frequent line shows that many; only where these two leave it open are (document, line) pairs joined, and then no
line has enough documents by itself.

Edge cases: null text stays null and has no lines; blank lines are kept and belong to no template; a line that a
document repeats counts once for it but every copy is dropped if it recurs; rows that share an id, or have none, are
told apart by their texts; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEADING, MIN_DOCS, SIMILAR = 2, 4, 60
#: Lines of more tokens recur from LONG_DOCS documents on.
LONG_TOKENS, LONG_DOCS = 50, 2
FIELD = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"
#: A line without these has single spaces only; bytes are sought, which costs a sixth of an expression.
_ODD_SPACE = ("\t", "\x0b", "\x0c", "\r", "  ")


#: Bits of a filter: the bound of what is sent to each task (2 MB).
FILTER_BITS = 1 << 24


def template_lines(text: str) -> Column:
    """The lines with white space made single, then with variable fields masked; '' for a blank line.

    Two transforms, so that each step's input is computed once.
    """
    odd = lambda x: reduce(or_, [F.contains(x, F.lit(c)) for c in _ODD_SPACE])
    single = lambda x: F.trim(F.when(odd(x), F.regexp_replace(x, _SPACE, " ")).otherwise(x))
    masked = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^ ]*[0-9][^ ]*", F.lit(FIELD))).otherwise(x)
    return F.transform(F.transform(F.split(text, "\n"), single), masked)


def token_count(line: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def leaf_of(line: str) -> Column:
    """Hash of the tree path of a masked line: token count and leading tokens."""
    return F.xxhash64(token_count(line) - 1, F.substring_index(line, " ", LEADING))


def masked_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos, line, leaf, hash, enough) of every line that is not blank; its leaf tells how many documents are enough."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")  # a text is hashed once, not for each of its lines
    lines = texts.select("doc_id", "text_hash", F.posexplode(template_lines("text")).alias("pos", "line")).where("line != ''")
    enough = F.when(token_count("line") > LONG_TOKENS, min(LONG_DOCS, min_docs)).otherwise(min_docs)
    return lines.withColumns({"leaf": leaf_of("line"), "hash": F.xxhash64("line"), "enough": enough})


def bit_filter(values: DataFrame, column: str, bits: int = FILTER_BITS) -> Column:
    """A one-row array of ``bits`` bits in which the slots of the values are set, as a scalar."""
    slot = F.pmod(F.col(column), F.lit(bits))
    one = F.expr("1L")
    words = values.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", one, F.pmod(F.col("s"), F.lit(64)).cast("int"))).alias("w"))
    every = values.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("a")).select(F.col("a.w").alias("a"))
    return written(ordered, "bits").scalar()


def passes(bits: Column, column: str, n: int = FILTER_BITS) -> Column:
    slot = F.pmod(F.col(column), F.lit(n))
    return F.bit_get(F.get(bits, F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1


def held_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that enough distinct documents hold."""
    return rows.select(*keys, "enough", "text_hash").distinct().groupBy(*keys).agg(F.count("*").alias("docs"), F.first("enough").alias("enough")).where("docs >= enough").select(*keys)


def recurring_lines(docs: DataFrame, table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, hash) of the distinct masked lines whose template recurs; ``table`` is ``masked_lines`` without ``line``."""
    enough = F.first("enough").alias("enough")
    counts = written(table.select("text_hash", "leaf", "hash", "enough").distinct().groupBy("leaf", "hash").agg(F.count("*").alias("n"), enough), "line-counts")
    busy = written(counts.groupBy("leaf").agg(F.sum("n").alias("all"), enough).where("all >= enough").select("leaf"), "busy-leaves")
    seen = masked_lines(docs, min_docs).where(passes(bit_filter(busy, "leaf"), "leaf")).select("leaf", "hash", "line").distinct()
    held = written(seen.join(counts.join(busy, "leaf"), ["leaf", "hash"]), "leaf-lines")
    tokens = held.select("leaf", "hash", "n", "enough", F.posexplode(F.split("line", " ")).alias("pos", "token")).where(F.col("token") != FIELD)
    tokens = tokens.withColumn("spot", F.xxhash64("leaf", "pos", "token"))
    sums = written(tokens.groupBy("spot").agg(F.sum("n").alias("k"), F.max("n").alias("top"), enough).where("k >= enough"), "token-counts")
    rare = held.where("n < enough").select("leaf", "hash")
    pairs = table.where(passes(bit_filter(rare, "hash"), "hash")).select("text_hash", "leaf", "hash").distinct()
    pairs = written(pairs.join(rare, ["leaf", "hash"]), "line-docs")
    open_ = bit_filter(sums.where("top < enough"), "spot")
    spots = tokens.where(F.col("n") < F.col("enough")).where(passes(open_, "spot")).select("leaf", "hash", "spot", "enough").join(pairs, ["leaf", "hash"])
    shown = held_by(spots, ["spot"])
    fixed = written(sums.where("top >= enough").select("spot").union(shown).distinct(), "fixed-tokens")
    marked = tokens.where(passes(bit_filter(fixed, "spot"), "spot")).join(fixed, "spot")
    # a template is told by its fixed tokens and their places; the leaf holds the token count
    shape = marked.groupBy("leaf", "hash").agg(F.count("*").alias("k"), F.sum(F.col("spot").cast("decimal(20,0)")).alias("sum"), F.bit_xor("spot").alias("xor"))
    lines = held.select("leaf", "hash", "n", "enough", token_count("line").alias("size")).join(shape, ["leaf", "hash"], "left")
    general = F.coalesce(100 * F.col("k") >= SIMILAR * F.col("size"), F.lit(False))
    template = F.when(general, F.concat_ws(":", "k", "sum", "xor")).otherwise(F.concat(F.lit("="), F.col("hash").cast("string")))
    named = written(lines.select("leaf", "hash", "n", "enough", template.alias("template")), "templates")
    totals = named.groupBy("leaf", "template").agg(F.sum("n").alias("total"), F.max("n").alias("top"), enough).where("total >= enough")
    doubtful = named.join(totals.where("top < enough"), ["leaf", "template"], "left_semi").select("leaf", "hash", "enough", "template")
    often = totals.where("top >= enough").select("leaf", "template").union(held_by(doubtful.join(pairs, ["leaf", "hash"]), ["leaf", "template"]))
    return named.join(often, ["leaf", "template"], "left_semi").select("leaf", "hash")


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines: ``text`` is replaced; ``n_lines`` and ``n_dropped`` follow (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    table = written(masked_lines(docs.select("doc_id", "text"), min_docs).drop("line"), "line-table")
    gone = recurring_lines(docs.select("doc_id", "text"), table, min_docs)
    # places of the recurring lines, by document; equal texts of one id have equal places
    places = table.join(gone, ["leaf", "hash"]).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    joined = docs.select(*keep).join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_gone = F.coalesce(F.size("_gone"), F.lit(0))
    out = joined.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(n_gone).cast("long"), "_text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))})
    return out.withColumn("text", F.col("_text")).select(*keep, "n_lines", "n_dropped")


def oracle(min_docs: int = MIN_DOCS) -> str:
    """The same in SQL for an outside engine: for each template and fixed token the distinct texts that hold it are counted."""
    masked = r"(CASE WHEN regexp_matches({x}, '[0-9]') THEN regexp_replace({x}, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE {x} END)"
    single = r"trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))"
    return f"""
WITH raw AS (SELECT doc_id, h, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT doc_id, md5(text) AS h, string_split(text, chr(10)) AS ls FROM documents)),
line AS (SELECT doc_id, h, p, l, {masked.format(x=single)} AS m FROM raw),
dist AS (SELECT DISTINCT h, m FROM line WHERE m <> ''),
held AS (SELECT m, string_split(m, ' ') AS w, count(*) AS n FROM dist GROUP BY m),
leafed AS (SELECT m, w, n, concat_ws(chr(31), CAST(len(w) AS VARCHAR), w[1], coalesce(w[2], '')) AS leaf, CASE WHEN len(w) > {LONG_TOKENS} THEN {min(LONG_DOCS, min_docs)} ELSE {min_docs} END AS enough FROM held),
busy AS (SELECT leaf FROM leafed GROUP BY leaf, enough HAVING sum(n) >= enough),
tok AS (SELECT leaf, m, enough, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM leafed SEMI JOIN busy USING (leaf)),
fixed AS (SELECT leaf, p, t FROM tok JOIN dist USING (m) WHERE t <> '<*>' GROUP BY leaf, p, t, enough HAVING count(DISTINCT h) >= enough),
shape AS (SELECT tok.leaf, tok.m, tok.enough, string_agg(coalesce(fixed.t, '<*>'), ' ' ORDER BY tok.p) AS g, count(fixed.t) AS k, count(*) AS size FROM tok LEFT JOIN fixed ON fixed.leaf = tok.leaf AND fixed.p = tok.p AND fixed.t = tok.t GROUP BY tok.leaf, tok.m, tok.enough),
named AS (SELECT leaf, m, enough, CASE WHEN 100 * k >= {SIMILAR} * size THEN g ELSE m END AS template FROM shape),
often AS (SELECT leaf, template FROM named JOIN dist USING (m) GROUP BY leaf, template, enough HAVING count(DISTINCT h) >= enough),
gone AS (SELECT DISTINCT m FROM named JOIN often USING (leaf, template)),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY p) AS t, count(*) AS n FROM line ANTI JOIN gone USING (m) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(total.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(total.n, 0) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS text_sha256
FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
