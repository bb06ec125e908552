"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

A line goes if an equal line, or one within its budget of single-character edits, stands earlier in the corpus (by
document id and line number). The budget of a pair is that of its shorter line (``BUDGETS``). Equal lines meet by two
hashes of the whole line. For the others, pigeonholes: a line cut into edits + 1 segments keeps one of them whole.

1. Each distinct line is cut into edits + 1 even segments; (length, segment number, segment) is hashed to one key.
2. It probes the segments of lines up to ``edits`` characters shorter by its own substrings, at the places that the
   multi-match bound leaves: for segment i those within i - 1 of the segment's place and within edits + 1 - i of it
   after the lengths' difference. For equal lengths the places of the segments themselves are met from one side.
3. In a key of few lines all pairs are candidates, but for those that letter counts rule out. In a key that more lines
   share, every line is first compared with the earliest one; a line that has found an earlier near line needs no
   other. If more than a few stay open, the shared segment is taken out, what is left of the lines is cut finer, and
   lines meet under that key by all pieces but as many as there are edits, until few are open. What is left gets
   shorter at every turn, so this ends, and a line meets a bounded number of others for each key that it is in: no
   group of lines is ever paired with itself.
4. Candidates are verified on whole lines: common ends are stripped by binary search on prefixes; where both ends of
   what remains must be edited, its inside rules most pairs out; the banded bit-parallel edit distance, whose word
   slides along the diagonal, decides.

Defined cases: a null text is one empty line; lines of white space alone are never dropped and match nothing; lines
shorter than the first budget's length match equal lines only; of equal places (rows with equal ids) the lesser hash of
the text counts as earlier, a null id as latest; a line may be kept alive by nothing: if the earlier line is dropped
itself, the later one goes too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, looked_up, stage, text_of, with_row

Budgets = tuple[tuple[int, int], ...]
#: (least length, edits) by ascending length: the budget of a pair is that of its shorter line.
BUDGETS: Budgets = ((4, 1), (16, 2))
#: Lines of one key that are paired as they are; in larger groups lines that stay open are cut again.
FEW = 1024
#: Characters that are counted in every candidate line.
COUNTED = ("etaoinr ", "shdlucmf")
#: By edits, the pieces that what is left of a line is cut into.
PIECES = {1: 4, 2: 6, 3: 7, 4: 8}
NOT_WHITE = r"[^\x09-\x0D\x20]"


def _segment(line: Column, start: Column, size: Column, length: Column, number: int) -> Column:
    return F.xxhash64(length, F.lit(number), F.substring(line, start + 1, size))


def _cuts(length: Column, edits: int) -> list[Column]:
    return [F.floor(length * k / (edits + 1)).cast("int") for k in range(edits + 2)]


def _own_places(length: Column, edits: int) -> list[tuple[int, Column, Column, int]]:
    """(segment, start, size, 0) of a line's own segments."""
    cuts = _cuts(length, edits)
    return [(k, cuts[k], cuts[k + 1] - cuts[k], 0) for k in range(edits + 1)]


def _probe_places(length: Column, edits: int, shorter: int) -> list[tuple[int, Column, Column, int]]:
    """(segment, start, size, shorter) of the substrings to look up among lines that many characters shorter."""
    cuts, places = _cuts(length - shorter, edits), []
    for k in range(edits + 1):
        for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1):
            if shorter or shift:
                places.append((k, cuts[k] + shift, cuts[k + 1] - cuts[k], shorter))
    return places


def _within_step(length: Column, budgets: Budgets, k: int) -> Column:
    return (length >= budgets[k][0]) & (length < budgets[k + 1][0]) if k + 1 < len(budgets) else length >= budgets[k][0]


def _graded(length: Column, budgets: Budgets, asking: bool, value, kind: str) -> Column:
    """One array of ``value(place, edits)`` for all places: the shorter line's budget says how it was cut."""
    parts = []
    for k, (_, edits) in enumerate(budgets):
        for shorter in range(edits + 1 if asking else 1):
            places = _probe_places(length, edits, shorter) if asking else _own_places(length, edits)
            parts.append(F.when(_within_step(length - shorter, budgets, k), F.array(*[value(x, edits) for x in places])).otherwise(F.array().cast(kind)))
    return F.concat(*parts)


def segment_keys(line: Column, length: Column, budgets: Budgets, asking: bool) -> Column:
    """Keys of the line's own segments, or those under which lines of the same length or shorter may lie."""
    return _graded(length, budgets, asking, lambda x, _: _segment(line, x[1], x[2], length - x[3], x[0]), "array<bigint>")


def segment_places(length: Column, budgets: Budgets, asking: bool) -> Column:
    """Where the keys' substrings lie, in the same order."""

    def place(x, edits: int) -> Column:
        return F.struct(x[1].alias("start"), x[2].alias("size"), F.lit(x[3]).alias("shorter"), F.lit(edits).alias("edits"))

    return _graded(length, budgets, asking, place, "array<struct<start:int,size:int,shorter:int,edits:int>>")


def letter_counts(line: Column) -> Column:
    """How often some common characters occur, a byte for each (127 at most)."""

    def packed(letters: str) -> Column:
        counts = [F.least(F.char_length(line) - F.char_length(F.translate(line, c, "")), F.lit(127)).cast("long") for c in letters]
        return functools.reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(n, 8 * k) for k, n in enumerate(counts)])

    return F.struct(*[packed(letters).alias(f"s{k}") for k, letters in enumerate(COUNTED)])


def like_letters(a: Column, b: Column, edits: int) -> Column:
    """What counts rule out: an edit changes two of them at most, by one."""
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(127).cast("long"))
    differences = [F.abs(byte(a[f"s{w}"], k) - byte(b[f"s{w}"], k)) for w, letters in enumerate(COUNTED) for k in range(len(letters))]
    return functools.reduce(lambda x, y: x + y, differences) <= 2 * edits


def within_budget(a: Column, b: Column, budgets: Budgets) -> Column:
    """Whether two strings are within the edits that the shorter one's length allows."""
    least = F.least(F.char_length(a), F.char_length(b))
    return F.coalesce(*[F.when(_within_step(least, budgets, k), within_edits(a, b, edits)) for k, (_, edits) in enumerate(budgets)], F.lit(False))


def _common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix, by binary search over powers of two, for strings of any length that Spark holds."""

    def step(found: Column, power: Column) -> Column:
        longer = found + power
        return F.when((longer <= most) & (F.substring(a, F.lit(1), longer) == F.substring(b, F.lit(1), longer)), longer).otherwise(found)

    powers = lambda bits: F.array(*[F.lit(1 << k) for k in range(bits, -1, -1)])
    return F.aggregate(F.when(most < 1024, powers(9)).otherwise(powers(30)), F.lit(0), step)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits."""
    pair = F.struct(a.alias("a"), b.alias("b"))

    def strip(x: Column) -> Column:
        head = _common_prefix(x["a"], x["b"], F.least(F.char_length(x["a"]), F.char_length(x["b"])))
        return F.struct(F.substring(x["a"], head + 1, F.char_length(x["a"])).alias("a"), F.substring(x["b"], head + 1, F.char_length(x["b"])).alias("b"))

    def turn(x: Column) -> Column:
        return F.struct(F.reverse(x["a"]).alias("a"), F.reverse(x["b"]).alias("b"))

    apply = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  names a value, so that it is computed once
    middle = apply(apply(apply(apply(pair, strip), turn), strip), turn)

    def decide(x: Column) -> Column:
        la, lb = F.char_length(x["a"]), F.char_length(x["b"])
        # neither the first nor the last characters agree, so with longer strings both ends take an edit of their own
        if edits == 1:
            return F.greatest(la, lb) <= 1
        further = F.abs(la - lb) <= edits
        if edits == 2:
            ends = [(1, 1), (1, 0), (0, 1)]
            inside = [F.substring(x["a"], F.lit(1 + i), la - i - k) == F.substring(x["b"], F.lit(1 + j), lb - j - m) for i, j in ends for k, m in ends]
            further &= functools.reduce(lambda p, q: p | q, inside)
        return F.when(F.greatest(la, lb) <= edits, True).when(further, _banded_distance(_characters(x["a"]), _characters(x["b"]), edits) <= edits).otherwise(False)

    return apply(middle, decide)


def _characters(x: Column) -> Column:
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))


def _banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance in a band of 2 * edits + 1 diagonals as bit vectors: bit k of step j stands for row j - edits + k of ``a``,
    an array of characters.

    Vertical differences +1 and -1 are two words; each step shifts them along the diagonal. The score follows the
    band's lowest diagonal and, past the end of ``a``, its last row."""
    width = 2 * edits + 1
    n, m = F.size(a), F.size(b)
    top = 1 << (width - 1)
    full = (1 << width) - 1

    def bit(k: int, j: Column) -> Column:
        row = j - edits + k
        return F.when((row >= 1) & (row <= n) & (F.get(a, row - 1) == F.get(b, j - 1)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

    def step(state: Column, j: Column) -> Column:
        match = bit(0, j)
        for k in range(1, width):
            match = match.bitwiseOR(bit(k, j))

        def advance(x: Column) -> Column:
            plus, minus, eq = x["plus"], x["minus"], x["eq"]
            d0 = (eq.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(eq).bitwiseOR(minus).bitwiseAND(F.lit(full).cast("long"))
            hp = minus.bitwiseOR(F.bitwise_not(d0.bitwiseOR(plus))).bitwiseAND(F.lit(full).cast("long"))
            hn = d0.bitwiseAND(plus)
            slid = F.shiftright(d0, 1)
            score = x["score"] + F.when(j + edits <= n, F.when(d0.bitwiseAND(F.lit(top).cast("long")) != 0, 0).otherwise(1)).otherwise(
                F.when(_at(hp, n - j + edits) != 0, 1).when(_at(hn, n - j + edits) != 0, -1).otherwise(0)
            )
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(slid.bitwiseOR(hp))).bitwiseAND(F.lit(full).cast("long")).alias("plus"), slid.bitwiseAND(hp).alias("minus"), score.alias("score")
            )

        return F.transform(F.array(F.struct(state["plus"].alias("plus"), state["minus"].alias("minus"), match.alias("eq"), state["score"].alias("score"))), advance)[0]

    start = F.struct(F.lit(full - ((1 << edits) - 1)).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), F.least(n, F.lit(edits)).alias("score"))
    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda x: x["score"])


def _at(word: Column, k: Column) -> Column:
    return F.expr("0L") if k is None else word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(k, F.lit(62))))


def _left_out(edits: int) -> list[tuple[int, int, int, int, int, int]]:
    """(role, shorter, piece, another, end of that, shift between): the pieces that hold all edits, and how far characters
    between them are shifted. With one edit the other piece is empty."""
    found, pieces = [], PIECES[edits]
    for role, less in [(0, 0), *((1, d) for d in range(edits + 1))]:
        if edits == 1:
            found += [(role, less, i, i + 1, i + 1, less) for i in range(pieces)]
            continue
        for left in itertools.combinations(range(pieces), 2) if edits == 2 else ():
            i, j = left
            shifts = {0} if role == 0 or j == i + 1 else {0, less, *(s for s in (-1, 0, 1) if abs(less - s) <= 1)}
            found += [(role, less, i, j, j + 1, s) for s in sorted(shifts)]
        if edits > 2:  # one piece out of few is left as it is, wherever the rest's edits are
            found += [(role, less, i, -1, i + 1, s) for i in range(edits + 1) for s in ((0,) if role == 0 else range(less - edits, edits + 1))]
    return found


def _cut_again(rest: Column, key: Column, role: Column, shorter: Column, edits: Column, budgets: Budgets) -> Column:
    """Keys of what is left of a line under one key: (key, role, rest, shorter).

    With as few characters as edits, one that agrees is enough, at any place; a pair without any was decided when it
    met the group's earliest line. A segment in its place also asks, for equal lengths, with shifted pieces."""
    n_all = F.char_length(rest)
    kind = "array<struct<key:bigint,role:int,rest:string,shorter:int>>"
    sub = lambda start, size: F.substring(rest, start + 1, size)

    def finer(c: Column, most: int) -> Column:
        n = n_all - c["less"]
        pieces = F.least(n, F.lit(PIECES[most] if most <= 2 else most + 1))
        cut = lambda k: F.floor(n * k / pieces).cast("int")
        i, j, k, s, d = c["i"], c["j"], c["k"], c["s"], c["less"]
        outside = F.xxhash64(key, n, i, j, sub(F.lit(0), cut(i)), sub(cut(i + 1) + s, cut(j) - cut(i + 1)), sub(cut(k) + d, n - cut(k)))
        inside = F.concat(sub(cut(i), cut(i + 1) + s - cut(i)), sub(cut(j) + s, cut(k) + d - cut(j) - s))
        fits = (k <= pieces) & (cut(i + 1) + s >= cut(i)) & (cut(k) + d >= cut(j) + s)
        if most > 2:
            outside = F.xxhash64(key, n, i, j, sub(cut(i) + s, cut(k) - cut(i)))
            inside = F.concat(sub(F.lit(0), cut(i) + s), sub(cut(k) + s, n_all - cut(k) - s))
            fits = (k <= pieces) & (cut(i) + s >= 0) & (cut(k) + s <= n_all)
        return F.when(fits, F.struct(outside.alias("key"), c["role"].alias("role"), inside.alias("rest"), d.alias("shorter")))

    def single(c: Column) -> Column:
        n = n_all - c["less"]
        hashed = F.xxhash64(key, n, -1 - c["i"], sub(c["j"], F.lit(1)))
        left = F.concat(sub(F.lit(0), c["j"]), sub(c["j"] + 1, n_all))
        return F.when((c["i"] < n) & (c["j"] < n_all), F.struct(hashed.alias("key"), c["role"].alias("role"), left.alias("rest"), c["less"].alias("shorter")))

    names = ("role", "less", "i", "j", "k", "s")
    told = lambda rows: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])
    parts = []
    for most in sorted({edits for _, edits in budgets}):
        ways = _left_out(most)
        singles = [(r, d, i, j, 0, 0) for r, d in [(0, 0), *((1, d) for d in range(most + 1))] for i in range(most) for j in range(most + d) if r or i == j]
        for as_role, less in [(0, 0), *((1, d) for d in range(most + 1))]:
            asked = lambda row: row[:2] == (as_role, less) or as_role == 0 and row[:2] == (1, 0)  # noqa: B023, E731
            again = F.transform(told([x for x in ways if asked(x)]), lambda c: finer(c, most))  # noqa: B023
            few = F.transform(told([x for x in singles if asked(x)]), single)
            mine = (edits == most) & (role == as_role) & ((shorter == less) if as_role else F.lit(True))
            parts.append(F.when(mine, F.filter(F.when(n_all - less > most, again).otherwise(few), lambda x: x.isNotNull())))
    return F.coalesce(*parts, F.array().cast(kind))


def _links(of: DataFrame, other: DataFrame, on: Column, budgets: Budgets) -> DataFrame:
    """The later line of each verified pair; both sides have a line, its letter counts and its place."""
    most = max(edits for _, edits in budgets)
    met = of.alias("a").join(other.alias("b"), on & like_letters(F.col("a._sig"), F.col("b._sig"), most))
    near = met.filter(within_budget(F.col("a._line"), F.col("b._line"), budgets))
    return near.select(F.when(F.col("a._place") < F.col("b._place"), F.col("b._x")).otherwise(F.col("a._x")).alias("_x")).distinct()


def _settle(items: DataFrame, budgets: Budgets, few: int) -> DataFrame:
    """_x of lines that have an earlier near line among those that share a key with them.

    ``items``: _key, _role (0: a segment in its place, 1: a probe), _x, _place, _sig, _line, _rest, _shorter, _edits, staged."""
    gone = None
    while True:
        firsts = items.filter("_role = 0").groupBy("_key").agg(F.min(F.struct("_place", "_x", "_sig", "_line")).alias("_p"), F.min("_place").alias("_own0"))
        reach = items.groupBy("_key").agg(F.min("_place").alias("_all0"), F.count(F.lit(1)).alias("_n"))
        groups = stage(firsts.join(reach.filter("_n > 1"), "_key").select("_key", "_p._place", "_p._x", "_p._sig", "_p._line", "_own0", "_all0"), "line-groups")
        held = items.join(groups.select("_key", "_own0", "_all0"), "_key")
        found = stage(_links(held, groups, F.expr("a._key = b._key AND a._x <> b._x"), budgets), "line-links")
        gone = found if gone is None else stage(gone.unionAll(found).distinct(), "lines-gone")
        # open: not known to go, and an earlier line of the group could still be near
        could = F.when(F.col("_role") == 0, F.col("_place") > F.col("_all0")).otherwise(F.col("_place") > F.col("_own0"))
        still = stage(held.filter(could).join(gone, "_x", "left_anti").drop("_own0", "_all0"), "open-lines")
        counts = stage(still.groupBy("_key").agg(F.count(F.lit(1)).alias("_open")), "open-counts")
        small = still.join(counts.filter(F.col("_open") <= few), "_key")
        pairs = F.expr("a._key = b._key AND a._role + b._role < 2 AND b._place < a._place AND a._x <> b._x")
        gone = stage(gone.unionAll(_links(small, items, pairs, budgets)).distinct(), "lines-gone")
        large = items.join(counts.filter(F.col("_open") > few).select("_key"), "_key", "left_semi")
        again = large.select("_x", "_place", "_sig", "_line", "_edits", F.explode(_cut_again(F.col("_rest"), F.col("_key"), F.col("_role"), F.col("_shorter"), F.col("_edits"), budgets)).alias("_i"))
        items = stage(again.select(F.col("_i.key").alias("_key"), F.col("_i.role").alias("_role"), "_x", "_place", "_sig", "_line", F.col("_i.rest").alias("_rest"), F.col("_i.shorter").alias("_shorter"), "_edits"), "line-items")
        if not items.limit(1).count():
            return gone


def line_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Budgets = BUDGETS, row_col: str | None = None, few: int = FEW) -> DataFrame:
    """One row per input row: _row, doc_id, n_lines, n_removed, n_near (removed for an earlier line that is near, not equal), dropped (line numbers)."""
    rows = df.withColumn("_row", F.col(f"`{row_col}`")) if row_col else with_row(df)
    rows = rows.select("_row", F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    measured = F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("l"), F.char_length(x).alias("n")))
    lines = rows.select("_row", "_id", "_h", F.posexplode(measured).alias("_pos", "_l")).select("_row", "_id", "_h", "_pos", F.col("_l.l").alias("_line"), F.col("_l.n").alias("_n"))
    line, length = F.col("_line"), F.col("_n")
    named = [F.xxhash64(line).alias("_k1"), F.xxhash64(F.lit(7), line).alias("_k2")]
    # a function that has no generated code keeps this projection out of whole-stage code, whose one method would be too
    # large for the JVM to compile
    blank = ~F.exists(F.array(line), lambda x: x.rlike(NOT_WHITE))
    long_enough = (length >= budgets[0][0]) & ~blank
    keys = [F.when(long_enough, segment_keys(line, length, budgets, asking)).alias(name) for asking, name in ((False, "_own"), (True, "_ask"))]
    keyed = lines.select("_row", "_id", "_h", "_pos", *named, blank.alias("_blank"), *keys)
    keyed = stage(keyed, "lines")
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("_row").alias("r"), F.col("_pos").alias("p"))
    distinct = stage(keyed.filter("NOT _blank").groupBy("_k1", "_k2").agg(F.min(place).alias("_place")), "distinct-lines")
    first = distinct.select("_k1", "_k2", "_place", F.col("_place.r").alias("_row"), F.col("_place.p").alias("_pos"))
    unique = keyed.filter("_own IS NOT NULL").select("_row", "_pos", "_own", "_ask").join(first, ["_row", "_pos"])
    unique = stage(unique.select(F.monotonically_increasing_id().alias("_x"), "_k1", "_k2", "_place", "_own", "_ask"), "unique-lines")

    own = unique.select("_x", F.posexplode("_own").alias("_at", "_key"))
    ask = unique.select("_x", F.posexplode("_ask").alias("_at", "_key"))
    counted = own.select("_key", F.lit(0).alias("_role")).unionAll(ask.select("_key", F.lit(1).alias("_role"))).groupBy("_key").agg(F.count_if(F.col("_role") == 0).alias("_owns"), F.count(F.lit(1)).alias("_n"))
    shared = stage(counted.filter("_owns > 0 AND _n > 1").select("_key", (F.col("_n") <= few).alias("_few")), "shared-keys")
    own, ask = (stage(x.join(looked_up(shared), "_key"), "segments") for x in (own, ask))
    wanted = stage(unique.select("_x", "_k1", "_k2", "_place").join(own.select("_x").unionAll(ask.select("_x")).distinct(), "_x"), "wanted-lines")
    texts = lines.select(*named, "_line").join(looked_up(wanted.select("_k1", "_k2")), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min("_line").alias("_line"))
    texts = stage(wanted.join(texts, ["_k1", "_k2"]).select("_x", "_place", "_line", letter_counts(F.col("_line")).alias("_sig")), "line-texts")

    side = lambda x, name: x.filter("_few").select("_key", "_x").join(texts.select("_x", "_sig"), "_x").select("_key", F.col("_x").alias(name), F.col("_sig").alias("_s" + name))
    alike = like_letters(F.col("_s_x"), F.col("_s_y"), max(edits for _, edits in budgets))
    # segments in their own places are met from one side only; the probes are for shorter lines or shifted places
    same = side(own, "_x").join(side(own, "_y"), "_key").filter((F.col("_x") < F.col("_y")) & alike).select("_x", "_y")
    moved = side(own, "_x").join(side(ask, "_y"), "_key").filter((F.col("_x") != F.col("_y")) & alike).select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    pairs = stage(same.unionAll(moved).distinct(), "line-pairs")
    sides = lambda x: texts.select(F.col("_x").alias(x), F.col("_place").alias("_p" + x), F.col("_line").alias("_l" + x))
    near = pairs.join(sides("_x"), "_x").join(sides("_y"), "_y").filter(within_budget(F.col("_l_x"), F.col("_l_y"), budgets))
    near = stage(near.select(F.when(F.col("_p_x") < F.col("_p_y"), F.col("_y")).otherwise(F.col("_x")).alias("_x")).distinct(), "near-lines")

    many = own.filter("NOT _few").withColumn("_role", F.lit(0)).unionAll(ask.filter("NOT _few").withColumn("_role", F.lit(1)))
    length = F.char_length("_line")
    spot = F.element_at(F.when(F.col("_role") == 0, segment_places(length, budgets, False)).otherwise(segment_places(length, budgets, True)), F.col("_at") + 1)
    items = many.join(texts, "_x").withColumn("_spot", spot)
    rest = F.concat(F.substring(F.col("_line"), F.lit(1), F.col("_spot.start")), F.substring(F.col("_line"), F.col("_spot.start") + F.col("_spot.size") + 1, length))
    items = stage(items.select("_key", "_role", "_x", "_place", "_sig", "_line", rest.alias("_rest"), F.col("_spot.shorter").alias("_shorter"), F.col("_spot.edits").alias("_edits")), "line-items")
    if items.limit(1).count():
        near = near.unionAll(_settle(items, budgets, few)).distinct()

    late = unique.select("_x", "_k1", "_k2").join(near, "_x").select("_k1", "_k2", F.lit(True).alias("_late"))
    facts = stage(distinct.join(late, ["_k1", "_k2"], "left").select("_k1", "_k2", F.col("_place.r").alias("_r"), F.col("_place.p").alias("_p"), F.coalesce("_late", F.lit(False)).alias("_late")), "line-facts")
    told = keyed.select("_row", "_id", "_pos", "_blank", "_k1", "_k2").join(facts, ["_k1", "_k2"], "left")
    is_first = (F.col("_row") == F.col("_r")) & (F.col("_pos") == F.col("_p"))
    gone = ~F.col("_blank") & (~is_first | F.col("_late"))
    return told.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("_first", F.coalesce(is_first, F.lit(False))).groupBy("_row").agg(
        F.first("_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), F.count_if("_gone").alias("n_removed"), F.count_if(F.col("_gone") & F.col("_first")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(F.col("_gone"), F.col("_pos")))).alias("dropped"),
    )


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Budgets = BUDGETS) -> DataFrame:
    """The input with the repeated lines cut out of its texts; rows and other columns stay. Null texts stay null."""
    row, gone = free_name(df, "_line_row"), free_name(df, "_line_gone")
    rows = stage(with_row(df, row), "line-input")
    dropped = line_decisions(rows, id_col, text_col, budgets, row).select(F.col("_row").alias(row), F.col("dropped").alias(gone))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, k: ~F.array_contains(gone, k)), "\n")
    return rows.join(dropped, row).withColumn(text_col, kept).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_decisions(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.array_join("dropped", ",").alias("dropped"))


#: Every pair of lines of like length, by edit distance over bytes: characters beyond ASCII stand as control characters
#: first (26 different ones at most). Letter counts rule pairs out before the distance is computed.
OP6_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), o AS (
  SELECT *, length(regexp_replace(line, '[\\x09-\\x0D\\x20]', '', 'g')) = 0 AS blank FROM l
), c AS (
  SELECT string_agg(ch, '' ORDER BY ch) AS chars FROM (
    SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\\x00-\\x7f]', '', 'g'), '')) AS ch FROM o) WHERE ch <> ''
), m AS (
  SELECT string_agg(chr(k), '' ORDER BY k) AS codes FROM (SELECT unnest(list_concat(range(1, 9), range(14, 32)))::INT AS k)
), d AS (
  SELECT line, min({'id': doc_id, 'p': pos}) AS f, length(line) AS n FROM o WHERE NOT blank GROUP BY line
), b AS (
  SELECT line, f, n, CASE WHEN n >= 16 THEN 2 WHEN n >= 4 THEN 1 ELSE 0 END AS e,
    translate(line, coalesce((SELECT chars FROM c), ''), (SELECT codes FROM m)) AS t,
    list_transform(['a', 'e', 'i', 'o', 'n', 't', 'h', 's', 'r', ' '], lambda ch: length(line) - length(replace(line, ch, ''))) AS counts
  FROM d
), v AS (
  SELECT x.line AS x, y.line AS y, x.f AS xf, y.f AS yf
  FROM b x JOIN b y ON y.n BETWEEN x.n AND x.n + x.e AND x.line <> y.line AND x.e > 0
  WHERE list_sum(list_transform(list_zip(x.counts, y.counts), lambda z: abs(z[1] - z[2]))) <= 2 * x.e AND levenshtein(x.t, y.t) <= x.e
), late AS (
  SELECT DISTINCT CASE WHEN xf < yf THEN y ELSE x END AS line FROM v
), t AS (
  SELECT o.doc_id, o.pos, d.f = {'id': o.doc_id, 'p': o.pos} AS first, NOT o.blank AND (d.f <> {'id': o.doc_id, 'p': o.pos} OR late.line IS NOT NULL) AS gone
  FROM o LEFT JOIN d ON o.line = d.line AND NOT o.blank LEFT JOIN late ON o.line = late.line AND NOT o.blank
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND first) AS n_near,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone), '') AS dropped
FROM t GROUP BY doc_id
"""
