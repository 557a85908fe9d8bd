"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame operations only.

1. Lines of the same words (lower-cased, white space aside) are folded into one line class, by the words
   themselves.
2. A class's tokens are its distinct runs of SHINGLE words, in the order of their hashes: one order for all.
3. Two sets that reach the threshold share a token among the first ``n - ceil(threshold * n) + 1`` of each (the
   prefix). Prefix entries whose token no other class has in its prefix are let go.
4. Tokens in the prefixes of more than FREQUENT classes would make too many candidates. All classes with such a token
   in their prefix are joined a second time among themselves, in another order: by rarity, counted over these classes
   in CELLS cells, then by hash. Two classes whose common prefix tokens are all frequent both take part in that, so
   no link is lost.
5. Classes that share a prefix token are candidates. The length filter and the positional filter (what may still
   follow the shared token) come first, within the join, then a bound on the overlap from the whole prefixes; what
   passes is verified by the Jaccard index of the whole sets.
6. Round one tests all classes of a token against two of them, the most copied one and the one with the smallest
   number (the largest, if the smallest is the most copied). What that links is one component. Round two tests every
   remaining pair of two components. Pairs inside a component need no test, so a group of like lines costs no pairs
   of its own, and no link is lost.

Lines that are equal or linked, directly or through others, form a group. The first line of a group (by doc_id,
then text digest, then place) stays, the later ones are removed.

Cases: null and empty texts have no lines to compare; a line without words is never removed. A line of fewer words
than a shingle has its whole word sequence as its one token. With ``min_words`` shorter lines are left alone. Rows of
one id and different texts are different documents, null ids included, and a null id comes before all others; rows
alike in id and text are one document, so each gets the same result. Ties in similarity don't matter. An empty table
gives an empty result. Lines of any length are compared whole. Extra columns are ignored, or kept by ``dedup``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components, scratch

SHINGLE, PERCENT, MIN_WORDS = 5, 75, 1
CELLS, CODE = 1 << 16, 16
#: Lines with the most copies, as many as this, have their rows spread over SALTS join keys.
HOT, SALTS = 1024, 64
#: A token in the prefixes of more classes than this is frequent: its classes are ordered anew, by rarity.
FREQUENT = 32
#: Longs of a bitmap of lines; the highest count of copies that the choice of a lead tells apart.
BITMAP, MOST = 1 << 15, 2047
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)


def digest(words: str = "words") -> list[Column]:
    """128 bits of a line's words, as h and g, by which copies find their class."""
    return [F.xxhash64(words).alias("h"), F.xxhash64(F.lit("second"), F.col(words)).alias("g")]


def doc_of(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.lit(NO_ID))


def spaced(line: Column) -> Column:
    """The line with one space between words and none at its ends. Regular lines, known by plain searches, are left as they are."""
    odd = reduce(lambda a, b: a | b, [line.contains(c) for c in ("  ", "\t", "\x0b", "\x0c", "\r")]) | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, "[\\x09-\\x0D\\x20]+", " "))).otherwise(line)


def once(df: DataFrame, value: Column, name: str, *carry: str) -> DataFrame:
    """``carry`` and ``value``, which a generator works out once, however often it is named later."""
    return df.select(*carry, F.explode(F.array(value)).alias(name))


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """doc (NO_ID for null), mark (tells texts of one id apart), pos (from 0), words: of each line with enough words."""
    marked = once(docs.select(doc_of(docs[id_col]).alias("doc"), docs[text_col].alias("text")), F.xxhash64("text"), "mark", "doc", "text")
    every = marked.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lowered = once(every, F.lower("line"), "line", "doc", "mark", "pos")
    lines = once(lowered, spaced(F.col("line")), "words", "doc", "mark", "pos").where("words <> ''")
    return lines if min_words <= 1 else lines.where(F.size(F.split("words", " ")) >= min_words)


def cell(token: Column) -> Column:
    return token.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def token_sets(classes: DataFrame, *carry: str) -> DataFrame:
    """``carry`` and t, the hashes of the class's distinct shingles; of fewer words, one hash of them all.

    The words' hashes, 63 bits as CODE hexadecimal digits each, stand in one string, of which a shingle is one piece.
    Lambdas are interpreted, so a piece is much cheaper than a hash of SHINGLE array elements. The string is a
    lambda's variable because a column would be copied for each piece.
    """
    code = lambda w: F.hex(F.xxhash64(w).bitwiseOR(F.lit(-(1 << 63))))
    coded = once(classes, F.array_join(F.transform(F.split("words", " "), code), "").cast("binary"), "b", *carry)
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("b") - (CODE * SHINGLE - 1), F.lit(1)), F.lit(CODE))
    runs = F.get(F.transform(F.array("b"), lambda b: F.transform(starts, lambda k: F.xxhash64(F.substr(b, k, F.lit(CODE * SHINGLE))))), F.lit(0))
    return once(coded, F.array_distinct(runs), "t", *carry)


def ranks(sets: DataFrame) -> list[int]:
    """A rank from 0 to 63 for each cell that rises with the number of sets its tokens are in, beyond the usual. CELLS numbers, whatever the corpus."""
    counts = sets.select(F.explode("t").alias("token")).groupBy(cell(F.col("token")).alias("c")).agg(F.count("*").alias("n")).collect()
    out = [0] * CELLS
    usual = sorted(n for _, n in counts)[len(counts) // 2] if len(counts) == CELLS else 0
    for c, n in counts:
        beyond = n - usual - 3 * math.sqrt(usual)
        out[c] = min(63, int(2 * math.log2(beyond + 1))) if beyond > 0 else 0
    return out


def longs(values: list[int]) -> Column:
    """These numbers as one literal array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def ordered(t: Column, table: list[int]) -> Column:
    """Tokens as longs whose natural order is rarest first. The table is a literal, so that no row carries it."""
    high = longs([k << 57 for k in table])
    return F.sort_array(F.transform(t, lambda x: F.get(high, cell(x)).bitwiseOR(x.bitwiseAND(F.lit((1 << 57) - 1)))))


def prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1


def parities(t: Column) -> list[Column]:
    """128 bits, in two longs: each is flipped once for each token that falls on it."""
    none = F.lit(0).cast("long")
    one = lambda k: (1 << k) - (1 << 64 if k == 63 else 0)
    half = lambda k: F.aggregate(t, none, lambda s, x: s.bitwiseXOR(F.get(longs([one(j % 64) if j // 64 == k else 0 for j in range(128)]), x.bitwiseAND(F.lit(127)).cast("int"))))
    return [half(0), half(1)]


def reach(n1: Column, n2: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))


def plausible(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """The filters for two sets of sizes n with a shared token at places i (from 0): length, position, and bitmaps p and q if both have them."""
    n1, n2 = a["n"], b["n"]
    length = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    least = reach(n1, n2, percent)
    position = F.least(a["i"], b["i"]) + F.least(n1 - a["i"], n2 - b["i"]) >= least
    # Tokens of one set only flip a bit each, so as many bits as differ are not in common.
    differ = F.bit_count(a["p"].bitwiseXOR(b["p"])) + F.bit_count(a["q"].bitwiseXOR(b["q"]))
    return length & position & F.coalesce(n1 + n2 - differ >= 2 * least, F.lit(True))


def of(prefix: str) -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("n", "i", "p", "q")}


def chosen(classes: DataFrame, lines: DataFrame) -> DataFrame:
    """The classes of ``lines``. A bitmap of fixed size keeps most others' words out of the join's shuffle; the join itself is exact, and of one kind at every size."""
    place = F.xxhash64("line").bitwiseAND(F.lit(64 * BITMAP - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = lines.select(F.shiftright(place, 6).alias("cell"), one.alias("one")).groupBy("cell").agg(F.bit_or("one").alias("bits"))
    there = classes.withColumn("cell", F.shiftright(place, 6)).join(F.broadcast(bitmap), "cell").where(F.col("bits").bitwiseAND(one) != 0).drop("cell", "bits")
    return there.join(lines.hint("merge"), "line")


def verified(pairs: DataFrame, classes: DataFrame, keys: DataFrame, steps: scratch.Steps, percent: int, name: str) -> DataFrame:
    """Of pairs (a, b) those whose token sets reach the threshold, written. Only lines of likely pairs are cut into tokens.

    Of the two prefixes, in the order of hashes, all tokens of the one that ends first and of the other set are in the
    other prefix, too. So what it doesn't share with the other prefix counts as a difference of the sets.
    """
    side = lambda c: keys.select(F.col("line").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")).hint("merge")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    least = reach(F.col("n_a"), F.col("n_b"), percent) + 1 - F.ceil(F.greatest("n_a", "n_b") * F.lit(percent) / 100)
    likely = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(shared >= least)
    pairs = steps.keep(likely.select("a", "b"), f"{name}-pairs")
    wanted = steps.keep(pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct(), f"{name}-wanted")
    sets = steps.keep(token_sets(chosen(classes.select("line", "words"), wanted), "line"), f"{name}-sets")
    half = lambda c, t: sets.select(F.col("line").alias(c), F.col("t").alias(t)).hint("merge")
    both = pairs.join(half("a", "s"), "a").join(half("b", "u"), "b")
    common = F.size(F.array_intersect("s", "u"))
    out = steps.keep(both.where(100 * common >= percent * (F.size("s") + F.size("u") - common)).select("a", "b"), name)
    steps.drop(f"{name}-pairs", f"{name}-wanted", f"{name}-sets")
    return out


def postings(sets: DataFrame, percent: int, table: list[int] | None = None) -> DataFrame:
    """Prefix entries of tokens that several classes have in their prefixes: key, k (classes of the key), and line, at (copies, n and i), p, q of an entry, e, and of the key's two leads, x and y.

    Lead x has the most copies, y the smallest number or, where that is x, the largest. Without a table the order is
    that of the hashes, and there are no bitmaps.
    """
    t, n = F.col("t"), F.size("t")
    bits = [] if table is None else ["p", "q"]
    sig = F.sort_array(t) if table is None else ordered(t, table)
    marked = sets.select("line", "copies", "t", *[c.alias(x) for c, x in zip(parities(t), bits)])
    entries = marked.select("line", "copies", *bits, n.alias("n"), F.posexplode(F.slice(sig, F.lit(1), prefix_size(n, percent))).alias("i", "key"))
    # copies (they only choose a lead, so few bits do), n and i in one long
    at = F.shiftleft(F.least("copies", F.lit(MOST)).cast("long"), 52) + F.shiftleft(F.col("n").cast("long"), 26) + F.col("i")
    several = entries.select("key", "line", at.alias("at"), *bits).withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1")
    leads, entry = Window.partitionBy("key"), F.struct("line", "at", *bits)
    ends = several.select("key", "k", entry.alias("e"), F.max_by(entry, F.struct(F.shiftright("at", 52), -F.col("line"))).over(leads).alias("x"), F.min_by(entry, "line").over(leads).alias("low"), F.max_by(entry, "line").over(leads).alias("top"))
    return ends.select("key", "k", "e", "x", F.when(F.col("x.line") == F.col("low.line"), F.col("top")).otherwise(F.col("low")).alias("y"))


def unpacked(entries: DataFrame) -> DataFrame:
    """key, k, line, n, i, p, q, and structs x and y with the last five: of what ``postings`` gives. Without bitmaps p and q are null."""
    part = lambda at, shift: F.shiftright(at, shift).bitwiseAND(F.lit((1 << 26) - 1)).cast("int")
    bit = lambda e, c: (F.col(f"{e}.{c}") if c in entries.schema["e"].dataType.names else F.lit(None).cast("long")).alias(c)
    whole = lambda e: [F.col(f"{e}.line"), part(f"{e}.at", 26).alias("n"), part(f"{e}.at", 0).alias("i"), bit(e, "p"), bit(e, "q")]
    return entries.select("key", "k", *whole("e"), *[F.struct(*whole(e)).alias(e) for e in "xy"])


def candidates(classes: DataFrame, steps: scratch.Steps, percent: int) -> tuple[DataFrame, DataFrame]:
    """Prefix entries, written, as ``unpacked`` gives them; any two classes that reach the threshold share a key. And each line's n and its keys in the order of hashes."""
    first = unpacked(steps.keep(postings(token_sets(classes, "line", "copies"), percent), "line-postings"))
    frequent = steps.keep(first.where(F.col("k") > FREQUENT).select("line").distinct(), "line-frequent")
    rare = first.where(F.col("k") <= FREQUENT)
    again = steps.keep(token_sets(chosen(classes.select("line", "words", "copies"), frequent), "line", "copies"), "line-again")
    second = unpacked(steps.keep(postings(again, percent, ranks(again)), "line-more-postings"))
    keys = steps.keep(first.groupBy("line").agg(F.max("n").alias("n"), F.collect_list("key").alias("keys")), "line-keys")
    steps.drop("line-frequent", "line-again")
    return rare.unionByName(second), keys


def find_links(classes: DataFrame, steps: scratch.Steps, percent: int) -> DataFrame:
    """(node, root) of all classes that are linked, but the roots: groups of classes."""
    members, keys = candidates(classes, steps, percent)
    met = []
    for name in "xy":
        lead = F.col(f"{name}.line")
        good = (F.col("line") != lead) & plausible(of(""), of(f"{name}."), percent)
        met.append(F.when(good, F.struct(F.least("line", lead).alias("a"), F.greatest("line", lead).alias("b"))))
    pairs = members.select(F.explode(F.array(*met)).alias("pair")).where("pair is not null").select("pair.*")
    first = verified(pairs, classes, keys, steps, percent, "line-links")

    labels = components.components(first).select(F.col("node").alias("line"), F.col("root").alias("label"))

    # Round two: what hasn't the label that most lines of a token have meets all others of the token. Up to three lines have met already.
    many = members.where("k > 3").select("key", "line", "n", "i", "p", "q", F.col("x.line").alias("x"), F.col("y.line").alias("y"))
    named = many.join(labels.hint("merge"), "line", "left").withColumn("label", F.coalesce("label", "line"))
    named = steps.keep(named, "line-named")
    main = named.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = named.join(main, "key")
    side = lambda s: open_.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("line", "n", "i", "p", "q", "label", "x", "y", "main")])
    rest = side("l").where(F.col("l_label") != F.col("l_main"))
    left, right = F.col("l_line"), F.col("r_line")
    tested = left.isin(F.col("l_x"), F.col("l_y")) | right.isin(F.col("l_x"), F.col("l_y"))
    fresh = (left < right) | (F.col("r_label") == F.col("r_main"))
    others = rest.join(side("r"), "key").where((F.col("l_label") != F.col("r_label")) & fresh & ~tested & plausible(of("l_"), of("r_"), percent))
    second = verified(others.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")), classes, keys, steps, percent, "line-more-links")
    # Round two joins whole components of round one: only their representatives need another run.
    up = lambda c: F.coalesce(F.col(f"label_{c}"), F.col(c)).alias(c)
    named_links = second
    for c in "ab":
        named_links = named_links.join(labels.select(F.col("line").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    above = components.components(named_links.select(up("a"), up("b"))).select(F.col("node").alias("label"), F.col("root").alias("top"))
    below = labels.join(above, "label", "left").select(F.col("line").alias("node"), F.coalesce("top", "label").alias("root"))
    alone = above.join(labels.select(F.col("line").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("root"))
    groups = steps.keep(below.unionByName(alone), "line-groups")
    steps.drop("line-postings", "line-more-postings", "line-keys", "line-named", "line-links", "line-more-links")
    return groups


def find_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line to remove: doc, mark, pos, and the document and place of its group's first line."""
    steps = scratch.Steps(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col, min_words)
    place = F.struct("doc", "mark", "pos")
    # Words decide; their hash comes first only because longs are sorted faster.
    folded = once(lines, digest()[0], "h", "doc", "mark", "pos", "words").groupBy("h", "words").agg(F.min(place).alias("at"), F.count("*").alias("copies"))
    classes = steps.keep(folded.select(F.monotonically_increasing_id().alias("line"), "words", "at", "copies", "h", digest()[1]), "line-classes")
    roots = find_links(classes, steps, percent)

    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "line")
    found = classes.select("line", "at", "copies", "h", "g")
    inside = steps.keep(chosen(found, grouped), "line-inside")
    inside = inside.join(inside.groupBy("root").agg(F.min("at").alias("start")), "root")
    alone = steps.keep(inside.where((F.col("copies") == 1) & (F.col("at") != F.col("start"))).select("at", "start"), "line-alone")
    apart = found.where("copies > 1").join(grouped.select("line"), "line", "left_anti").withColumn("start", F.col("at"))
    repeated = steps.keep(apart.select("h", "g", "copies", "start").unionByName(inside.where("copies > 1").select("h", "g", "copies", "start")), "line-copies")
    steps.drop("line-classes", "line-groups", "line-inside")

    hot = [r[0] for r in repeated.orderBy(F.desc("copies"), "h").limit(HOT).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = repeated.select("h", "g", "start", F.explode(salts).alias("salt"))
    hashed = lines.select(place.alias("at"), F.explode(F.array(F.struct(*digest()))).alias("v")).select("at", "v.h", "v.g")
    every = hashed.select("at", "h", "g", F.when(is_hot, F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    copies = every.join(salted, ["h", "g", "salt"]).where(F.col("at") != F.col("start")).select("at", "start")
    return copies.unionByName(alone).select("at.*", F.nullif(F.col("start.doc"), F.lit(NO_ID)).alias("match_doc"), F.col("start.pos").alias("match_pos"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row's id, n_lines, n_removed, removed (places from 0) and the ids of its removed lines' group starts (``match_ids``, sorted)."""
    gone = find_matches(docs, id_col, text_col, percent, min_words).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("removed"), F.sort_array(F.collect_set("match_doc")).alias("match_ids"))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("row_mark"), F.coalesce(F.octet_length(docs[text_col]) - F.octet_length(F.replace(docs[text_col], F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(gone, (doc_of(F.col("id")) == F.col("doc")) & (F.col("row_mark") == F.col("mark")), "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return joined.select(F.col("id").alias(id_col), F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none("int")).alias("removed"), F.coalesce("match_ids", none("bigint")).alias("match_ids"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, the text without the lines to remove."""
    gone = find_matches(docs, id_col, text_col, percent, min_words).groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.collect_set("pos").alias("__gone"))
    joined = docs.join(gone, (doc_of(docs[id_col]) == F.col("__doc")) & (F.xxhash64(docs[text_col]) == F.col("__mark")), "left")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), docs[text_col]).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
