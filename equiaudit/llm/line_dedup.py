"""Near-duplicate lines by a segment-partition edit join (operator 3).

A line that holds a word is removed if an earlier line (by document id, then
line number) is equal to it or similar: within a number of insertions,
deletions and replacements of single characters that grows with the length.
The shorter line of a pair allows one edit for each ``chars_per_edit`` of its
characters, ``max_edits`` at most; lines shorter than that are only compared
for equality.  The first line of its kind stays.

1. Lines are split off and hashed where the texts are read; only hashes are
   shuffled.  Equal lines become one by partial aggregation.
2. A line that allows e edits is cut into e + 1 even segments, which are
   indexed by length, number and content.  A similar line that is as long or
   longer has one of the segments unchanged, at a place that its length and the
   segment's number confine (multi-match-aware selection).  Each line probes
   the index of the lengths from ``max_edits`` less to its own, in each length
   with the segments of the band of lengths that it belongs to.
3. A pair that met must also agree in a signature, the numbers of twelve
   characters modulo 32: an edit changes two of them by one at most, so no
   similar pair is lost.  A segment that more than ``HOT_ROWS`` lines have is
   split by the first of these numbers, so that its lines are dealt over many
   tasks and meet those only whose number is near.
4. What is left is read again.  Of ``4 * max_edits`` pieces of the shorter line
   an edit spoils one at most, so the others must occur in the longer one; then
   the pair is verified by edit distance in a band of
   ``2 * max_edits + 1`` diagonals, held in the bits of one number and moved
   along the longer line's characters (bit-parallel, after Hyyrö).
5. Line numbers to remove go back to their documents.

Defined cases: null and empty texts, and lines without a word, have nothing to
remove and stay as they are.  Ids order as Spark orders them, null ids first.
Rows that repeat an id and its text are one document: each keeps what the first
of them keeps.  Other columns pass through ``deduplicated`` unchanged.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import WORD, text_or_empty, written

MAX_EDITS, CHARS_PER_EDIT = 2, 20
#: Lines of one segment beyond which the segment is split.
HOT_ROWS = 1_000
#: Removed lines of a document that are looked up one by one.
FEW_LINES = 64
#: Common characters of many languages; any others would do, with less effect.
SIGNATURE = " etaoinsrhld"


def allowed_edits(length: Column, max_edits: int, chars_per_edit: int) -> Column:
    """Edits between a line of this length and one that is as long or longer."""
    return F.least(F.lit(max_edits), F.floor(length / chars_per_edit).cast("int"))


def segment_bounds(length: Column, k: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``k`` of a line cut into ``edits + 1``; the last ones are longer."""
    parts = edits + 1
    base, even = F.floor(length / parts).cast("int"), F.lit(parts) - length % parts  # ``even``: those not longer
    return base * k + F.greatest(F.lit(0), F.lit(k) - even), base + (F.lit(k) >= even).cast("int")


def _key(code: Column, start: Column, size: Column, length: Column, k: int) -> Column:
    """``code``: the line in UTF-32, where a substring is found without counting characters."""
    return F.xxhash64(F.substring(code, start * 4 + 1, size * 4), length, F.lit(k))


def _allows(length: Column, edits: int, max_edits: int, chars_per_edit: int) -> Column:
    """Whether a line of this length is in the band that allows just so many edits."""
    out = length >= chars_per_edit * edits
    return out if edits == max_edits else out & (length < chars_per_edit * (edits + 1))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def index_keys(code: Column, length: Column, max_edits: int, chars_per_edit: int) -> Column:
    out = _none()
    for edits in range(1, max_edits + 1):
        keys = F.array(*[_key(code, *segment_bounds(length, k, edits), length, k) for k in range(edits + 1)])
        out = F.when(_allows(length, edits, max_edits, chars_per_edit), keys).otherwise(out)
    return out


def probes(max_edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, less, k, shift): where segment k of a line that is ``less`` shorter and allows ``edits`` can be."""
    return [(edits, less, k, shift)
            for edits in range(1, max_edits + 1) for less in range(edits + 1) for k in range(edits + 1)
            # at most k edits before the segment, and the others after it
            for shift in range(max(-k, less - (edits - k)), min(k, less + edits - k) + 1)]


def probe_keys(code: Column, length: Column, max_edits: int, chars_per_edit: int) -> Column:
    """Keys of the substrings that segments of lines up to ``max_edits`` shorter, or as long, can be, but for the line's
    own segments, whose keys are the ``index_keys``."""
    def keys(least: int, always: bool) -> list[Column]:
        out = []
        for edits, less, k, shift in probes(max_edits):
            if edits < least or not (less or shift):
                continue
            other = length - less
            start, size = segment_bounds(other, k, edits)
            key = _key(code, start + shift, size, other, k)
            out.append(key if always else F.when(_allows(other, edits, max_edits, chars_per_edit), key))
        return out

    if not max_edits:
        return _none()
    # away from the edges of the bands every key is there
    return F.when(length >= chars_per_edit * max_edits + max_edits, F.array(*keys(max_edits, True))).when(
        length >= chars_per_edit, F.array_compact(F.array(*keys(1, False)))).otherwise(_none())


def signature(line: Column) -> Column:
    """The numbers, modulo 32, of twelve characters, five bits each."""
    out, rest = F.lit(0).cast("long"), line
    for i, c in enumerate(SIGNATURE):
        without = F.replace(rest, F.lit(c))  # counted in what the ones before have left
        n = F.octet_length(rest) - F.octet_length(without)
        out, rest = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(31)).cast("long"), 5 * i)), without
    return out


def first_number(signature: Column) -> Column:
    return signature.bitwiseAND(F.lit(31).cast("long"))


def signature_distance(a: Column, b: Column) -> Column:
    """At most the sum of the differences of the numbers, which are known modulo 32."""
    out = F.lit(0).cast("long")
    for i in range(len(SIGNATURE)):
        apart = F.abs(first_number(F.shiftrightunsigned(a, 5 * i)) - first_number(F.shiftrightunsigned(b, 5 * i)))
        out = out + F.least(apart, 32 - apart)
    return out


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two strings where it is at most ``edits``, and a larger number elsewhere.  The strings are
    longer than ``edits`` and differ in length by no more.

    Bit d of a vector is row j - edits + d of column j of the distance matrix (rows: characters of ``a``).  ``u`` and
    ``d`` mark vertical steps of +1 and -1, ``z`` diagonal steps of 0.  The distance k follows the lowest diagonal of
    the band to the last row, and then that row to the last column.  The characters are bound by a lambda, so that
    Spark splits the strings once and not at every step."""
    width = 2 * edits + 1
    ones, zero = F.lit((1 << width) - 1).cast("long"), F.lit(0).cast("long")

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(ones)

    def bit(x: Column, at: Column | int) -> Column:
        return F.call_function("shiftright", x, F.lit(at) if isinstance(at, int) else at).bitwiseAND(F.lit(1).cast("long"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(c: Column, s: Column, j: Column) -> Column:
        equal = zero
        for d in range(width):
            same = F.get(c["a"], j - 1 - edits + d) == F.get(c["b"], j - 1)
            equal = equal + F.when(same, F.lit(1 << d).cast("long")).otherwise(zero)

        def diagonal(v: Column) -> Column:
            z = (v["e"].bitwiseAND(v["u"]) + v["u"]).bitwiseAND(ones).bitwiseXOR(v["u"])
            z = z.bitwiseOR(v["e"]).bitwiseOR(v["d"])
            return let(F.struct(z.alias("z"), v["u"].alias("u"), v["d"].alias("d")), horizontal)

        def horizontal(v: Column) -> Column:
            plus, minus = v["d"].bitwiseOR(flip(v["z"].bitwiseOR(v["u"]))), v["z"].bitwiseAND(v["u"])
            return let(F.struct(v["z"].alias("z"), plus.alias("p"), minus.alias("m")), vertical)

        def vertical(v: Column) -> Column:
            shifted, last = F.shiftright(v["z"], 1), c["n"] - j + edits
            k = F.when(j <= c["n"] - edits, 1 - bit(v["z"], 2 * edits)).otherwise(
                bit(v["p"], last) - bit(v["m"], last))
            return F.struct(v["m"].bitwiseOR(flip(shifted.bitwiseOR(v["p"]))).alias("u"),
                            shifted.bitwiseAND(v["p"]).alias("d"), (s["k"] + k).alias("k"))

        start = F.struct(equal.alias("e"), s["u"].alias("u"), s["d"].alias("d"))
        return F.when(s["k"] > 3 * edits, s).otherwise(let(start, diagonal))  # can't come down to ``edits``

    begin = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("u"), zero.alias("d"),
                     F.lit(edits).cast("long").alias("k"))
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("n"))
    return let(chars, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.size(c["b"])), begin, lambda s, j: step(c, s, j), lambda s: s["k"]))


def pieces_found(a: Column, b: Column, parts: int) -> Column:
    """How many of ``parts`` even pieces of ``a`` occur in ``b``: an edit spoils one at most."""
    n, out = F.char_length(a), F.lit(0)
    for k in range(parts):
        start = F.floor(n * k / parts).cast("int")
        piece = F.substring(a, start + 1, F.floor(n * (k + 1) / parts).cast("int") - start)
        out = out + F.contains(b, piece).cast("int")
    return out


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, of, no, line): every line of every row; (doc_id, of) names the row."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("of"), text.alias("text"))
    return rows.select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def meeting_pairs(first: DataFrame, max_edits: int, chars_per_edit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): pairs of distinct lines that share a segment and agree in their signatures, a not longer than b."""
    def exploded(keys: Column, name: str) -> DataFrame:
        return first.select(F.col("h1").alias(name), F.col("n").alias(f"n{name}"), F.col("signature").alias(f"s{name}"),
                            F.explode(keys).alias("key"))

    index, probe = exploded(F.col("index_keys"), "a"), exploded(F.concat("index_keys", "probe_keys"), "b")
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows)
    hot = written(hot.select(F.col("key").alias("hot")), "hot-segments")  # Catalyst broadcasts it by its size
    none = F.lit(-1).cast("long")
    near = F.array_distinct(F.transform(F.sequence(F.lit(-max_edits), F.lit(max_edits)),
                                        lambda x: F.pmod(first_number(F.col("sb")) + x, F.lit(32).cast("long"))))
    index = index.join(hot, F.col("key") == F.col("hot"), "left").withColumn(
        "part", F.when(F.col("hot").isNull(), none).otherwise(first_number(F.col("sa")))).drop("hot")
    probe = probe.join(hot, F.col("key") == F.col("hot"), "left").withColumn(
        "part", F.explode(F.when(F.col("hot").isNull(), F.array(none)).otherwise(near))).drop("hot")
    met = index.join(probe, ["key", "part"]).where(
        ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
        & (signature_distance(F.col("sa"), F.col("sb")) <= 2 * allowed_edits(F.col("na"), max_edits, chars_per_edit)))
    return met.select("a", "b").distinct()


def similar_lines(first: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_edits: int,
                  chars_per_edit: int) -> DataFrame:
    """(doc_id, of, no) of every distinct line that has an earlier similar one.  ``first``: the distinct lines."""
    pairs = written(meeting_pairs(first, max_edits, chars_per_edit), "line-pairs")

    # the texts of lines that met, from their documents
    wanted = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    wanted = first.join(wanted, "h1").select("at.*", "h1").groupBy("doc_id", "of").agg(
        F.collect_list(F.struct("no", "h1")).alias("wanted"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("own"),
                       text_or_empty(text_col).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("of")))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    texts = rows.select("doc_id", "of", F.explode(F.transform("wanted", lambda w: F.struct(
        w["h1"].alias("h1"), w["no"].alias("no"), F.get("lines", w["no"]).alias("line")))).alias("w"))
    texts = written(texts.select("w.h1", F.struct("doc_id", "of", "w.no").alias("at"), "w.line").distinct(), "line-texts")
    a, b = (texts.select(F.col("h1").alias(x), F.col("at").alias(f"at_{x}"), F.col("line").alias(f"line_{x}"))
            for x in "ab")
    allowed = allowed_edits(F.char_length("line_a"), max_edits, chars_per_edit)
    parts = 4 * max_edits
    close = pairs.join(a, "a").join(b, "b").where(
        pieces_found(F.col("line_a"), F.col("line_b"), parts) >= parts - allowed).where(
        edit_distance(F.col("line_a"), F.col("line_b"), max_edits) <= allowed)
    return close.select(F.greatest("at_a", "at_b").alias("at")).select("at.*").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS,
                   chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, of, no): the lines to remove, numbered from 0."""
    if chars_per_edit <= 2 * max_edits:
        raise ValueError("chars_per_edit must be more than twice max_edits")
    lines = lines_of(docs, id_col, text_col).where(F.col("line").rlike(WORD))
    names = {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), F.col("line"))}
    line, code, n = F.col("line"), F.col("code"), F.col("n")
    coded = lines.withColumns(names | {"code": F.encode("line", "UTF-32")})
    hashed = coded.withColumn("n", (F.octet_length("code") / 4).cast("int")).select(
        "h1", "h2", "n", F.struct("doc_id", "of", "no").alias("at"), signature(line).alias("signature"),
        index_keys(code, n, max_edits, chars_per_edit).alias("index_keys"),
        probe_keys(code, n, max_edits, chars_per_edit).alias("probe_keys"))
    first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("c"), *[
        F.any_value(c).alias(c) for c in ("n", "signature", "index_keys", "probe_keys")])
    first = written(first, "distinct-lines")
    near = similar_lines(first, docs, id_col, text_col, max_edits, chars_per_edit)
    own = lines.withColumns(names).select("h1", "h2", F.struct("doc_id", "of", "no").alias("own"))
    again = own.join(first.where("c > 1").select("h1", "h2", "at"), ["h1", "h2"]).where(F.col("own") != F.col("at"))
    return written(again.select("own.*").unionByName(near), "removed-lines")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS,
                 chars_per_edit: int = CHARS_PER_EDIT, counts: bool = False) -> DataFrame:
    """``docs`` without the repeated lines, with ``counts`` also __lines and __removed, the numbers of lines."""
    gone = repeated_lines(docs, id_col, text_col, max_edits, chars_per_edit).groupBy("doc_id", "of").agg(
        F.collect_set("no").alias("__gone")).withColumnsRenamed({"doc_id": "__id", "of": "__of"})
    own = docs.withColumn("__own", F.xxhash64(id_col, text_col))
    both = own.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__of")), "left")
    both = both.withColumn("__all", F.split(text_col, "\n"))
    # a few lines are looked up one by one; many by hashing, in time linear in a document's lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__gone"))
    left = F.when(F.size("__gone") <= FEW_LINES, F.filter(
        "__all", lambda x, i: ~F.array_contains(F.col("__gone"), i))).otherwise(
        F.transform(stay, lambda i: F.get("__all", i)))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    numbers = [F.coalesce(F.size("__all"), F.lit(0)).cast("long").alias("__lines"),
               F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__removed")] if counts else []
    return both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *numbers)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256); a null text counts as no line and as empty."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = deduplicated(own, counts=True, **options)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
                      F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))
