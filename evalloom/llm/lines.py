"""Near-duplicate line removal by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, numbered, salted_join, semi_join, sized_broadcast, table

#: Lines are cut into blocks of so many characters at most; one edit touches one block.
BLOCK = 128
#: Shorter lines have no near copies, and stay even if equal unless ``min_exact`` says otherwise.
MIN_CHARS = 24
#: Narrow rows (doc_id, line numbers) that may be broadcast; more are shuffled.
MAX_BROADCAST_ROWS = 200_000
#: A line with more than white space.
_INK = r"[^\x20\x09-\x0D]"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _pieces(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _chain(pieces: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... pieces."""
    return F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda got, x: F.concat(got, F.array(F.xxhash64(F.element_at(got, -1), x))))


def _key(cls: Column, j: Column, rest: Column) -> Column:
    return F.struct(cls.alias("cls"), j.alias("j"), rest.alias("rest"))


def _halves(line: Column) -> Column:
    """Hashes of what lies outside either half, for the line's own length and the next shorter one."""
    n = F.length(line)
    keys = []
    for skip in (0, 1):
        w = F.ceil((n - skip) / 2).cast("int")
        keys += [F.xxhash64(n - skip, F.lit(0), F.substring(line, w + skip + 1, n)), F.xxhash64(n - skip, F.lit(1), F.substring(line, F.lit(1), w))]
    return F.array(*keys)


def _blocks(line: Column) -> Column:
    """Array of (cls, j, rest): for the line's own length and the next shorter one, the hash of all that
    lies outside block j. Two lines one edit apart agree on ``rest`` for the edited block."""
    n = F.length(line)
    # bound once: inside a lambda it would be computed again for every block
    parts = F.struct(n.alias("n"), _chain(_pieces(line)).alias("p"), *[_chain(F.reverse(_pieces(F.substring(line, skip + 1, 1 << 30)))).alias(f"q{skip}") for skip in (0, 1)])

    def of(c: Column, skip: int) -> Column:
        bound = F.struct((c["n"] - skip).alias("cls"), F.greatest(F.ceil((c["n"] - skip) / BLOCK).cast("int"), F.lit(1)).alias("count"), c["p"].alias("p"), c[f"q{skip}"].alias("q"))
        return F.flatten(F.transform(F.array(bound), lambda c: F.transform(F.sequence(F.lit(0), c["count"] - 1), lambda j: _key(
            c["cls"], j, F.xxhash64(c["cls"], j, F.get(c["p"], j), F.get(c["q"], c["count"] - 1 - j))
        ))))

    return F.flatten(F.transform(F.array(parts), lambda c: F.concat(of(c, 0), of(c, 1))))


def _variants(block: Column, own: Column) -> Column:
    """(kind, hash) of a block's deletion neighbourhood.

    Kind i >= 0: character i deleted from a line of the class's own length; two lines that share it
    differ by a substitution at i. Kind -1: the undeleted block of the shorter line; kind -2: the block
    of the longer line with one character deleted, hashed alike, so a -1 and a -2 differ by an insertion.
    """
    n = F.length(block)
    gone = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
        F.when(own, i - 1).otherwise(F.lit(-2)).alias("kind"), F.xxhash64(F.concat(F.substring(block, F.lit(1), i - 1), F.substring(block, i + 1, F.lit(BLOCK + 1)))).alias("v"),
    ))
    whole = F.array(F.struct(F.lit(-1).alias("kind"), F.xxhash64(block).alias("v")))
    return F.when(own, F.concat(gone, whole)).otherwise(F.array_distinct(gone))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two lines differ by one edit at most. Equal blocks at the head are passed over; the edit must then
    lie in the next block, and what follows it be equal: time grows with the lines' length, not its square."""
    swap, far = F.length(a) > F.length(b), F.lit(1 << 30)
    pair = F.array(F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("l")))
    first = F.transform(pair, lambda c: F.struct(c["s"].alias("s"), c["l"].alias("l"), F.array_position(F.zip_with(_pieces(c["s"]), _pieces(c["l"]), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).alias("k")))
    at = lambda c: F.greatest(c["k"] - 1, F.lit(0)) * BLOCK + 1
    tails = F.transform(first, lambda c: F.struct(F.substring(c["s"], at(c).cast("int"), far).alias("s"), F.substring(c["l"], at(c).cast("int"), far).alias("l"), (F.length(c["l"]) - F.length(c["s"])).alias("d")))
    return F.transform(tails, lambda c: c["d"].between(0, 1)
        & F.levenshtein(F.substring(c["s"], F.lit(1), F.lit(BLOCK)), F.substring(c["l"], F.lit(1), c["d"] + BLOCK), 1).between(0, 1)
        & (F.substring(c["s"], F.lit(BLOCK + 1), far) == F.substring(c["l"], c["d"] + BLOCK + 1, far)))[0]


def removed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_exact: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, line_no) of the lines that an earlier line equals or differs from by at most one edit.

    Lines are ordered by (doc_id, line_no). A line of ``min_chars`` or more characters goes if an earlier
    line lies within edit distance 1, whether that one stays or not. A shorter one of ``min_exact`` or more
    (not given: none) goes if it equals an earlier one; lines of white space alone never go by that.

    1. Equal lines: the earliest place of each content, summed map-side.
    2. One edit leaves a half of a line as it is, and all blocks of 128 characters but one. Keys of what
       lies outside a half, then outside a block, can hold a pair only where two contents share them;
       only such blocks are expanded into deletion variants, so the expansion follows the near copies
       and not the corpus.
    3. Equal variants are joined. Sharing one already means one edit, so the earliest member of a key
       stands for all the others: a key with very many lines costs its size, not its square.
    4. Edit distance is verified on the lines' texts.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    text = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    lines = text.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    long_enough = F.length("line") >= min_chars
    exact = lines.where(long_enough if min_exact is None else long_enough | ((F.length("line") >= min_exact) & F.col("line").rlike(_INK)))
    lines = lines.where(long_enough)
    content = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.length("line"), "line").alias("h2")]
    at = F.struct("doc_id", "line_no")

    keyed = exact.select("doc_id", "line_no", *content)
    many = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("d0"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many, place = scratch.pin(many), ["doc_id", "line_no"]
    repeats = scratch.pin(salted_join(keyed, many, ["h1", "h2"], "n", place))
    first_no = repeats.where("doc_id = d0").groupBy("h1", "h2").agg(F.min("line_no").alias("l0"))
    first_no = scratch.pin(first_no.join(many.select("h1", "h2", "n"), ["h1", "h2"]))
    copies = scratch.pin(salted_join(repeats, first_no, ["h1", "h2"], "n", place).where("doc_id <> d0 or line_no <> l0").select("doc_id", "line_no"))

    def sharing(keyed_rows: DataFrame, *columns: str) -> DataFrame:
        """The rows whose key two contents have; very common keys are dealt out by line."""
        keys = keyed_rows.groupBy("rest").agg(F.min("h1").alias("a"), F.max("h1").alias("z"), F.count(F.lit(1)).alias("n")).where("a <> z").select("rest", "n")
        return semi_join(keyed_rows.select("rest", *columns), scratch.pin(keys), ["rest"], "n", place, MAX_BROADCAST_ROWS)

    halves = lines.select("doc_id", "line_no", content[0], F.explode(_halves(F.col("line"))).alias("rest"))
    some = sharing(halves, *place).select(*place)
    # later copies of a content add nothing
    some = scratch.pin(some.join(sized_broadcast(copies, MAX_BROADCAST_ROWS), ["doc_id", "line_no"], "left_anti").distinct())
    held = scratch.pin(some.select("doc_id").distinct())
    wanted = scratch.pin(lines.join(sized_broadcast(held, MAX_BROADCAST_ROWS), "doc_id", "left_semi").join(some, ["doc_id", "line_no"], "left_semi"))

    # few rows become many: dealt out by number, as their size says little about the work
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    blocks = wanted.repartition(spread, "doc_id", "line_no").select("doc_id", "line_no", content[0], "line", F.explode(_blocks(F.col("line"))).alias("b"))
    own = F.col("b.cls") == F.length("line")
    block = F.substring(F.col("line"), F.col("b.j") * BLOCK + 1, F.least(F.lit(BLOCK), F.col("b.cls") - F.col("b.j") * BLOCK) + F.when(own, 0).otherwise(1))
    blocks = scratch.pin(blocks.select("doc_id", "line_no", "h1", F.col("b.rest").alias("rest"), F.col("b.j").alias("j"), own.alias("own"), block.alias("block")))
    live = sharing(blocks, *place, "own", "block", "j").repartition(spread, "doc_id", "line_no", "j")
    v = live.select("doc_id", "line_no", "rest", F.explode(_variants(F.col("block"), F.col("own"))).alias("x"))
    v = v.select("doc_id", "line_no", F.col("x.kind").alias("kind"), F.xxhash64("rest", F.greatest(F.col("x.kind"), F.lit(-1)), "x.v").alias("key"))
    v = scratch.pin(v)
    whole, cut = F.col("kind") == -1, F.col("kind") == -2
    first = v.groupBy("key").agg(F.min(F.when(~cut, at)).alias("plain"), F.min(F.when(cut, at)).alias("longer"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = salted_join(v, scratch.pin(first), ["key"], "n", place).select("doc_id", "line_no", F.when(F.col("kind") >= 0, F.col("plain")).when(whole, F.col("longer")).otherwise(F.col("plain")).alias("by"))
    pairs = scratch.pin(met.where(F.col("by").isNotNull() & ((F.col("by.doc_id") < F.col("doc_id")) | ((F.col("by.doc_id") == F.col("doc_id")) & (F.col("by.line_no") < F.col("line_no"))))).select("doc_id", "line_no", F.col("by.doc_id").alias("d0"), F.col("by.line_no").alias("l0")).distinct())
    left = pairs.join(wanted, ["doc_id", "line_no"])
    right = wanted.select(F.col("doc_id").alias("d0"), F.col("line_no").alias("l0"), F.col("line").alias("line0"))
    # an earliest line may have very many near copies
    follow = scratch.pin(pairs.groupBy("d0", "l0").agg(F.count(F.lit(1)).alias("n")))
    near = salted_join(left, right.join(follow, ["d0", "l0"]), ["d0", "l0"], "n", place, known=follow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()).where(one_edit(F.col("line"), F.col("line0"))).select("doc_id", "line_no").distinct()
    return copies.unionByName(scratch.pin(near)).distinct()


def dedup_lines(docs: DataFrame, *, by_row: bool = False, **params) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and ``n_lines, n_removed``.

    Null texts and ids pass unchanged with null counts for the former; an empty text is one empty line;
    rows that repeat a doc_id lose the same lines; other columns are kept (``n_lines``, ``n_removed`` and
    names starting with ``_ln`` or ``_at`` are reserved). ``by_row`` numbers the rows: each then loses its own
    lines, those that repeat an id too, and those without one come last. An empty table stays one.
    """
    scratch, key, kept_columns = Scratch(docs.sparkSession, "lines"), "doc_id", docs.columns
    if by_row:
        docs, key = numbered(docs, "_ln_row", Scratch(docs.sparkSession, "rows")), "_ln_row"
        none = F.col("doc_id").isNull()
        place = F.struct(none.alias("none"), F.when(~none, F.col("doc_id").cast("long")).otherwise(F.lit(0)).alias("id"), F.col("_ln_row").alias("row"))
        gone = removed_lines(docs.select(place.alias("doc_id"), "text"), scratch=scratch, **params).select(F.col("doc_id.row").alias("_ln_row"), "line_no")
    else:
        gone = removed_lines(docs, scratch=scratch, **params)
    per = scratch.pin(gone.groupBy(key).agg(F.collect_set("line_no").alias("_ln_gone")))
    scratch.keep(per)
    got = docs.join(per.hint("merge"), key, "left")  # one strategy at every size
    all_ = split_lines(F.col("text"))
    # bound once, so that neither the lines nor those gone are looked at again for each line
    bound = F.array(F.struct(all_.alias("lines"), F.col("_ln_gone").alias("gone")))
    kept = F.transform(bound, lambda b: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), b["gone"]), lambda i: F.get(b["lines"], i)), "\n"))[0]
    text = F.when(F.col("_ln_gone").isNull(), F.col("text")).otherwise(kept)
    got = got.withColumns({"n_lines": F.size(all_).cast("long"), "n_removed": F.when(F.col("text").isNotNull(), F.coalesce(F.size("_ln_gone"), F.lit(0))).cast("long"), "text": text})
    return got.select(*kept_columns, "n_lines", "n_removed")


def op6_line_dedup(spark, sf_dir):
    """All documents' lines; digests of the texts that stay."""
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH a AS (SELECT doc_id, string_split("text", chr(10)) ls FROM documents WHERE "text" IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 AS no FROM a),
c AS (SELECT line, min((doc_id, no)) p FROM l WHERE length(line) >= 24 GROUP BY line),
v AS (SELECT line, p, line AS k FROM c UNION SELECT line, p, line[:i-1] || line[i+1:] FROM (SELECT line, p, unnest(range(1, length(line) + 1)) i FROM c WHERE EXISTS
   (SELECT 1 FROM (SELECT x FROM (SELECT left(line, length(line)//2) x FROM c UNION ALL SELECT right(line, length(line)//2 - 1) FROM c) GROUP BY x HAVING count(*) > 1) h WHERE h.x = left(c.line, length(c.line)//2) OR h.x = right(c.line, length(c.line)//2 - 1) OR h.x = left(c.line, (length(c.line)-1)//2) OR h.x = right(c.line, (length(c.line)-1)//2 - 1)))),
n AS (SELECT DISTINCT t.line FROM v t JOIN v s ON t.k = s.k AND s.p < t.p AND levenshtein(s.line, t.line) <= 1),
g AS (SELECT l.doc_id, l.no, l.line, (length(l.line) >= 24 AND (c.p <> (l.doc_id, l.no) OR n.line IS NOT NULL)) gone FROM l LEFT JOIN c ON c.line = l.line LEFT JOIN n ON n.line = l.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(CASE WHEN NOT coalesce(gone, false) THEN line END, chr(10) ORDER BY no), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""
