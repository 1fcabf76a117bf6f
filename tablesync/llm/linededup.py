"""Line dedup with a log-template tree of fixed depth (operator 4, DataFrame functions only).

A line's tokens are what stands between spaces; a token with a digit is a variable field, ``<*>``.
The tree parses a line by its number of tokens and then by its four leading tokens; that path is its
leaf. A leaf's template has, at each position, the token that most of the leaf's lines have there,
and ``<*>`` where no token has half of them. A line that equals the template in 70 % of its
positions or more belongs to it; any other line is a template of its own. Lines of a template that
recurs across documents are dropped, wherever they stand.

A template recurs if three documents vouch for it; shorter lines recur by chance and need more: twice
as many for each token under six. A document vouches if at least half of the tokens of its other
lines are its own, that is stand in leaves that no other text reaches. So the lines of a group of
copies are not taken for boilerplate, however large the group is and wherever its members were
edited: nearly all their lines are each other's. Copies are left to near-duplicate removal, but lose
a template like any document once others vouch for it. Texts count once, whatever their copies.

Scale: a first pass writes hashes of every line. Whether a leaf is shared is an aggregate of its
least and largest text hash, so a line that a third of all documents share is harmless; only lines
of shared leaves go on, once per text. Templates come from aggregates per leaf and position, never
from a list of a leaf's lines, and are written before lines join them, so that the join can split a
leaf with many lines. Vouching documents are counted by plain aggregates. The last pass joins each
document with the numbers of its dropped lines.

Defined cases: null text stays null, empty text empty; lines of spaces alone separate paragraphs and
stay; every document keeps its row, also one that loses all lines; a document without other lines
vouches for nothing; rows of equal text have equal results, and ids do not matter; of tokens that are
equally frequent, the last in code point order enters the template; empty table: no rows; other
columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import unused
from tablesync.workspace import written

#: Leading tokens on a line's path; the share of positions in which a line must equal its template.
DEPTH, SIMILAR = 4, 0.7

#: Documents that must vouch for a template; tokens under which it takes twice as many for each token less.
VOUCHING, SHORT = 3, 6

FIELD = "<*>"


def _tokens(line: Column) -> Column:
    plain = F.split(line, " ")
    masked = F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(plain)


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))


def text_key() -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u")]


def parsed(docs: DataFrame) -> DataFrame:
    """Every text: ``t``, ``u`` (its key) and ``lines``: numbers and tokens of those that are not blank."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda s, i: F.struct(i.alias("no"), s.alias("s")))
    lines = F.filter(lines, lambda x: F.trim(x["s"]) != "")
    lines = F.transform(lines, lambda x: F.struct(x["no"].alias("no"), _tokens(x["s"]).alias("tokens")))
    return docs.where("text is not null").select(*text_key(), lines.alias("lines"))


def hashed(docs: DataFrame) -> DataFrame:
    """A row per line: ``t``, ``u`` (key of its text), ``all`` (tokens of the text), ``no``, ``leaf``, ``line`` (hash) and ``n`` (tokens)."""

    def entry(x: Column) -> Column:
        tokens = x["tokens"]
        return F.struct(x["no"].alias("no"), _leaf(tokens).alias("leaf"), F.xxhash64(tokens).alias("line"), F.size(tokens).alias("n"))

    rows = parsed(docs).select("t", "u", F.transform("lines", entry).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])
    rows = rows.withColumn("all", total).select("t", "u", "all", F.explode("lines").alias("l"))
    return rows.select("t", "u", "all", "l.no", "l.leaf", "l.line", "l.n")


def enough(count: str, tokens: str) -> Column:
    """Do ``count`` documents make a line of that many ``tokens`` recur?"""
    return F.col(count) >= VOUCHING * F.pow(F.lit(2), F.greatest(F.lit(0), SHORT - F.col(tokens)))


def shared_lines(docs: DataFrame) -> DataFrame:
    """The lines of leaves that stand in several texts, once per text: the columns of :func:`hashed`."""
    lines = written(hashed(docs), "lines")
    leaves = lines.groupBy("leaf").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    leaves = written(leaves.where("least != most").select("leaf"), "shared-leaves")
    return lines.join(broadcast_if_small(leaves), "leaf", "left_semi").distinct()


def templates(lines: DataFrame) -> DataFrame:
    """``leaf``, ``template`` of every leaf, from distinct lines ``leaf``, ``tokens`` and their counts ``n``."""
    at = lines.select("leaf", "n", F.posexplode("tokens").alias("pos", "token"))
    votes = at.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    best = votes.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("best"), F.sum("n").alias("n"))
    token = F.when(F.col("best.n") * 2 >= F.col("n"), F.col("best.token")).otherwise(F.lit(FIELD))
    rows = best.select("leaf", F.struct("pos", token.alias("token")).alias("t"))
    return rows.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]).alias("template"))


def placed_lines(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``line`` and ``template`` (a key) of the distinct lines whose leaves stand in enough texts to recur."""
    texts = shared.select("leaf", "t", "u", "n").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"))
    leaves = written(texts.where(enough("texts", "n")).select("leaf"), "leaves")
    again = parsed(docs).select(F.explode(F.transform("lines", lambda x: F.struct(_leaf(x["tokens"]).alias("leaf"), x["tokens"].alias("tokens")))).alias("l"))
    again = again.select("l.leaf", "l.tokens").join(broadcast_if_small(leaves), "leaf", "left_semi").distinct()
    counts = shared.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    known = written(again.withColumn("line", F.xxhash64("tokens")).join(counts, "line"), "known-lines")
    fits = F.zip_with("tokens", "template", lambda a, b: (a == b) & (b != FIELD))
    share = F.size(F.filter(fits, lambda x: x)) / F.size("tokens")
    group = F.when(share >= SIMILAR, F.concat(F.lit("leaf "), F.col("leaf"))).otherwise(F.concat(F.lit("line "), F.col("line")))
    found = known.join(broadcast_if_small(written(templates(known), "templates")), "leaf")
    return found.select("line", group.alias("template"))


def dropped(docs: DataFrame) -> DataFrame:
    """``t``, ``u`` (a text's key) and ``gone``: the numbers (from 0) of its dropped lines, for texts that lose any."""
    shared = written(shared_lines(docs), "shared-lines")
    groups = written(placed_lines(docs, shared), "line-templates")
    placed = shared.join(broadcast_if_small(groups), "line")
    stand = placed.groupBy("template", "t", "u").agg(F.sum("n").alias("here"), F.max("n").alias("n"))
    texts = shared.groupBy("t", "u").agg(F.max("all").alias("all"), F.sum("n").alias("shared"))
    others = F.col("all") - F.col("here")
    vouching = stand.join(texts, ["t", "u"]).where((others > 0) & ((F.col("all") - F.col("shared")) * 2 >= others))
    votes = vouching.groupBy("template").agg(F.count(F.lit(1)).alias("votes"), F.max("n").alias("n"))
    recurring = written(votes.where(enough("votes", "n")).select("template"), "recurring")
    bad = written(groups.join(broadcast_if_small(recurring), "template", "left_semi").select("line"), "bad-lines")
    return shared.join(broadcast_if_small(bad), "line", "left_semi").groupBy("t", "u").agg(F.collect_set("no").alias("gone"))


def dedupe(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates; with ``counts``, also ``n_lines`` and ``n_dropped``."""
    t, u, gone = unused(docs, "text_hash", "text_hash_2", "gone_lines")
    marks = dropped(docs).toDF(t, u, gone)
    keys = [F.when(F.col("text").isNotNull(), key).alias(name) for key, name in zip(text_key(), (t, u), strict=True)]
    rows = docs.select("*", *keys).join(broadcast_if_small(written(marks, "dropped-lines")), [t, u], "left")
    lines = F.split(F.col("text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    out = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
        out += [n.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*out)


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped``, and ``text``, what is left."""
    out = dedupe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "text")


_TOK = "CASE WHEN regexp_matches({0}, '[0-9]') THEN list_transform(string_split({0}, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) ELSE string_split({0}, ' ') END"
_ENOUGH = f"{{0}} >= {VOUCHING} * power(2, greatest(0, {SHORT} - {{1}}))"

SQL = f"""
WITH doc AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
split AS (SELECT text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM doc),
tok AS (SELECT text, no, {_TOK.format("s")} AS tokens FROM split WHERE trim(s) <> ''),
lines AS (SELECT *, len(tokens) AS n, array_to_string(list_concat([CAST(len(tokens) AS VARCHAR)], tokens[1:{DEPTH}]), ' ') AS leaf FROM tok),
texts AS (SELECT leaf, max(n) AS n, count(DISTINCT text) AS texts FROM lines GROUP BY leaf),
stats AS (SELECT text, sum(l.n) AS total, sum(CASE WHEN x.texts = 1 THEN l.n ELSE 0 END) AS own FROM lines l JOIN texts x USING (leaf) GROUP BY text),
known AS (SELECT leaf, tokens, count(*) AS n FROM lines
          WHERE leaf IN (SELECT leaf FROM texts WHERE texts > 1 AND {_ENOUGH.format("texts", "n")}) GROUP BY ALL),
spread AS (SELECT leaf, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM known),
votes AS (SELECT leaf, pos, token, sum(n) AS n FROM spread GROUP BY ALL),
best AS (SELECT leaf, pos, CASE WHEN 2 * max(n) >= sum(n) THEN arg_max(token, (n, token)) ELSE '<*>' END AS token FROM votes GROUP BY ALL),
templ AS (SELECT leaf, list(token ORDER BY pos) AS template FROM best GROUP BY leaf),
groups AS (SELECT k.leaf, k.tokens,
             CASE WHEN len(list_filter(list_zip(k.tokens, t.template), lambda x: x[1] = x[2] AND x[2] <> '<*>')) / CAST(len(k.tokens) AS DOUBLE) >= {SIMILAR}
                  THEN 'leaf ' || k.leaf ELSE 'line ' || array_to_string(k.tokens, ' ') END AS template
           FROM known k JOIN templ t ON t.leaf = k.leaf),
placed AS (SELECT g.template, l.text, l.no, l.n FROM lines l JOIN groups g ON g.leaf = l.leaf AND g.tokens = l.tokens),
stand AS (SELECT template, text, sum(n) AS here, max(n) AS n FROM placed GROUP BY ALL),
vouch AS (SELECT template, count(*) AS votes, max(s.n) AS n FROM stand s JOIN stats x USING (text)
          WHERE x.total > s.here AND 2 * x.own >= x.total - s.here GROUP BY template),
gone AS (SELECT DISTINCT text, no FROM placed WHERE template IN (SELECT template FROM vouch WHERE {_ENOUGH.format("votes", "n")})),
kept AS (SELECT s.text, count(*) AS n_lines, count(g.no) AS n_dropped, coalesce(string_agg(s.s, chr(10) ORDER BY s.no) FILTER (WHERE g.no IS NULL), '') AS rest
         FROM split s LEFT JOIN gone g ON g.text = s.text AND g.no = s.no GROUP BY s.text)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, k.rest AS text
FROM documents d LEFT JOIN kept k ON k.text = d.text
"""
