"""Joins on text similarity and on containment (SIM-02..07).

Texts are interned first: each distinct text is compared once, however many rows
carry it.  At high thresholds candidate pairs come from a prefix filter.  With the
trigrams of a text ordered from rare to common, two sets of Jaccard ratio at least
``t`` must share one of the first ``n - ceil(t * n) + 1`` trigrams, so common
trigrams never become join keys.  At low thresholds shared trigrams are counted.
Both give exact ratios and nothing is capped: only pairs that cannot reach ``t``
are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions.text import set_similarity, trigrams
from evgraph.operators.ordered import top_per_key
from evgraph.session import cut_lineage, stored

# Thresholds tried from high to low by :func:`top_similar`; the caller's own comes last.
TIERS = (0.5,)
# From this threshold on the prefix filter is used, below it shared trigrams are counted.
PREFIX_FROM = 0.4
# Most trigrams a side may have to be broadcast; at some forty bytes each, about ten megabytes.
BROADCAST_GRAMS = 250_000
# Most texts that are broadcast; claims of some hundred bytes make a few megabytes.
BROADCAST_TEXTS = 20_000


def intern(df: DataFrame, text: str) -> DataFrame:
    """Distinct non-null texts with their trigram sets: ``text``, ``grams``.

    Texts are written first, otherwise Spark moves the filter below the grouping and builds the trigrams of all rows.
    """
    d = cut_lineage(df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct())
    return d.withColumn("grams", trigrams(F.col("text"))).filter(F.size("grams") > 0)


@dataclass
class Side:
    """Numbered texts of one side with ranked trigrams, and how many trigrams there are."""

    rows: DataFrame
    n_grams: int


def _ranked(left: DataFrame, right: DataFrame) -> tuple[Side, Side]:
    """Both sides with a number per text and its trigrams ordered from rare to common.

    Rarity is counted over both sides.  The list gathered per text is bounded by
    the length of that text.  The result is written once, because every tier reads
    it and the numbers must not change.
    """
    both = left.select("text", "grams", F.lit(True).alias("is_left")).unionAll(
        right.select("text", "grams", F.lit(False))
    )
    flat = both.select("text", "is_left", F.explode("grams").alias("gram"))
    rarity = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(rarity, "gram").groupBy("text", "is_left").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda s: s["gram"]
        ).alias("ranked")
    )
    ranked = cut_lineage(ranked.withColumn("id", F.monotonically_increasing_id()))
    # Two numbers: they decide whether a side is small enough to be broadcast.
    n = ranked.agg(
        F.sum(F.when(F.col("is_left"), F.size("ranked"))),
        F.sum(F.when(~F.col("is_left"), F.size("ranked"))),
    ).first()
    return (
        Side(ranked.filter("is_left").select("id", "text", "ranked"), n[0] or 0),
        Side(ranked.filter("NOT is_left").select("id", "text", "ranked"), n[1] or 0),
    )


def _spread(side: Side, small: bool) -> DataFrame:
    """Rows of a side; the larger one spread by number over all shuffle partitions.

    Few bytes of text can still make very many pairs, so the partition count is
    fixed here instead of following the size of the input.
    """
    if small:
        return side.rows
    n = int(side.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.rows.repartition(n, "id")


def _meet(left: Side, right: Side, flat) -> DataFrame:
    """Join the exploded sides on the trigram; the smaller is broadcast when its size allows."""
    small_left = left.n_grams <= right.n_grams
    a, b = flat(_spread(left, small_left), "l"), flat(_spread(right, not small_left), "r")
    if min(left.n_grams, right.n_grams) <= BROADCAST_GRAMS:
        a, b = (F.broadcast(a), b) if small_left else (a, F.broadcast(b))
    return a.join(b, "gram")


def _fits(a: str, b: str, threshold: float) -> Column:
    """Sizes of sets with ratio >= t differ at most by the factor t."""
    slack = F.lit(1e-9)
    return (F.col(a) >= F.lit(threshold) * F.col(b) - slack) & (
        F.col(b) >= F.lit(threshold) * F.col(a) - slack
    )


def _prefix_pairs(left: Side, right: Side, threshold: float) -> DataFrame:
    """Numbers of texts with ratio >= threshold by the prefix filter; for high thresholds."""

    def prefix(d: DataFrame, side: str) -> DataFrame:
        n = F.size("ranked")
        keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
        return d.select(
            F.col("id").alias(f"{side}_id"), F.col("ranked").alias(side), n.alias(f"{side}_n"),
            F.posexplode(F.slice("ranked", 1, keep)).alias(f"{side}_pos", "gram"),
        )

    joined = _meet(left, right, prefix).filter(_fits("l_n", "r_n", threshold))
    # A pair that shares several prefix trigrams is kept once, at its first shared one,
    # which the two rows at hand decide; no distinct and no extra shuffle.
    earlier = F.arrays_overlap(
        F.slice("l", F.lit(1), F.col("l_pos")), F.slice("r", F.lit(1), F.col("r_pos"))
    )
    return (
        joined.filter(~earlier)
        .select("l_id", "r_id", set_similarity(F.col("l"), F.col("r")).alias("score"))
        .filter(F.col("score") >= threshold - 1e-9)
    )


def _counted_pairs(left: Side, right: Side, threshold: float) -> DataFrame:
    """The same by counting shared trigrams; for low thresholds, where prefixes spare little.

    Only numbers travel.  With the smaller side broadcast the counts of a text
    are complete in its own task.  Otherwise a trigram that very many texts share
    makes one large join key, which AQE splits.
    """

    def flat(d: DataFrame, side: str) -> DataFrame:
        return d.select(
            F.col("id").alias(f"{side}_id"), F.size("ranked").alias(f"{side}_n"),
            F.explode("ranked").alias("gram"),
        )

    joined = _meet(left, right, flat).filter(_fits("l_n", "r_n", threshold))
    both = joined.groupBy("l_id", "r_id", "l_n", "r_n").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("n") / (F.col("l_n") + F.col("r_n") - F.col("n"))
    return both.select("l_id", "r_id", score.alias("score")).filter(F.col("score") >= threshold - 1e-9)


def _id_pairs(left: Side, right: Side, threshold: float) -> DataFrame:
    """Pairs with ratio >= threshold by number: l_id, r_id, score."""
    find = _prefix_pairs if threshold >= PREFIX_FROM else _counted_pairs
    return find(left, right, threshold)


def _pairs(left: Side, right: Side, threshold: float) -> DataFrame:
    """Text pairs with ratio >= threshold: left_text, right_text, score."""
    names = lambda s, i, t: s.rows.select(F.col("id").alias(i), F.col("text").alias(t))
    return (
        _id_pairs(left, right, threshold)
        .join(names(left, "l_id", "left_text"), "l_id")
        .join(names(right, "r_id", "right_text"), "r_id")
        .select("left_text", "right_text", "score")
    )


def similar_texts(
    left: DataFrame, left_text: str, right: DataFrame, right_text: str, above: float
) -> DataFrame:
    """SIM-03: distinct text pairs with similarity > ``above``.

    Returns ``left_text``, ``right_text``, ``score``.
    """
    a, b = _ranked(intern(left, left_text), intern(right, right_text))
    return _pairs(a, b, above).filter(F.col("score") > above)


def top_similar(
    queries: DataFrame,
    query_text: str,
    items: DataFrame,
    item_text: str,
    item_id: str,
    *,
    above: float,
    k: int,
) -> DataFrame:
    """SIM-02/04: the ``k`` best items per distinct query text, score > ``above``.

    Ties go to the smaller item id.  High thresholds are tried first, because
    their prefixes are short; a query with ``k`` hits there is finished, since
    everything else scores lower.  Only the rest is tried at the next lower
    threshold, down to ``above``, so the result is exact.
    Returns ``query``, item id, item text, ``score``.
    """
    left, right = _ranked(intern(queries, query_text), intern(items, item_text))
    # Of items that share a text only the first k can be among the best k.
    per_text = top_per_key(
        items.select(F.col(item_text).alias("right_text"), F.col(item_id)).filter(
            F.col("right_text").isNotNull()
        ),
        ["right_text"],
        [F.col(item_id)],
        k,
    )
    found: DataFrame | None = None
    for tier in [t for t in TIERS if t > above] + [above]:
        hits = _pairs(left, right, tier).filter(F.col("score") > above)
        if tier != above:
            hits = cut_lineage(hits)
            full = hits.groupBy("left_text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            hits = hits.join(full.select("left_text"), "left_text", "left_semi")
            rest = left.rows.join(full.select(F.col("left_text").alias("text")), "text", "left_anti")
            left = Side(rest, left.n_grams)
        found = hits if found is None else found.unionAll(hits)
    best = found.join(per_text, "right_text").select(
        F.col("left_text").alias("query"), item_id, F.col("right_text").alias(item_text), "score"
    )
    return top_per_key(best, ["query"], [F.col("score").desc(), F.col(item_id)], k)


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """SIM-07: pairs (text, term) of distinct values where the text contains the term.

    Case does not matter.  Each term is looked up by one key, its rarest run of
    three characters (the whole term when shorter); a text offers all its runs
    of the lengths that keys have.  Matches are then verified.  Terms that are few are
    broadcast, so runs of texts are not shuffled.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    # Few bytes of text have very many runs.  Spark would leave out a repartition by the text itself.
    t = t.withColumn("low", F.lower("text")).repartition(n, "low")
    w = (
        terms.select(F.col(term).alias("term"))
        .filter(F.length("term") > 0)
        .distinct()
        .withColumn("low_term", F.lower("term"))
    )

    def runs(c: Column, size: int) -> Column:
        return F.when(
            F.length(c) >= size,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length(c) - (size - 1)),
                    lambda i: F.substring(c, i, size),
                )
            ),
        ).otherwise(F.array().cast("array<string>"))

    lt = F.col("low_term")
    # Three numbers: which short runs are wanted, and whether the terms are small enough to be broadcast.
    one, two, offers = w.agg(
        F.max(F.length(lt) == 1), F.max(F.length(lt) == 2), F.sum(F.greatest(F.length(lt) - 2, F.lit(1)))
    ).first()
    few = (offers or 0) <= BROADCAST_GRAMS
    sizes = [size for size, known in ((1, one), (2, two), (3, True)) if known]
    grams = t.select("text", "low", F.explode(F.concat(*[runs(F.col("low"), size) for size in sizes])).alias("gram"))
    offered = w.select(
        "term",
        "low_term",
        F.explode(F.when(F.length(lt) < 3, F.array(lt)).otherwise(runs(lt, 3))).alias("gram"),
    )
    # Count only runs that some term offers, and keep the rarest one per term.
    asked = offered.select("gram").distinct()
    wanted = grams.join(F.broadcast(asked) if few else asked, "gram", "left_semi")
    df = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    key = (
        offered.join(df, "gram", "left")
        .groupBy("term", "low_term")
        .agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("k")
        )
        .filter(F.col("k.df") > 0)
        .select("term", "low_term", F.col("k.gram").alias("gram"))
    )
    return (
        grams.join(F.broadcast(key) if few else key, "gram")
        .filter(F.contains("low", F.col("low_term")))
        .select("text", "term")
    )


def search_names(
    queries: DataFrame, query: str, nodes: DataFrame, *, above: float = 0.1, k: int = 20
) -> DataFrame:
    """SIM-02 for many queries: best nodes by name per query text."""
    return top_similar(queries, query, nodes, "name", "node_id", above=above, k=k)


def alias_candidates(
    names: DataFrame, name: str, aliases: DataFrame, *, threshold: float = 0.5, k: int = 10
) -> DataFrame:
    """SIM-04: resolved aliases at or above the threshold, best ``k`` per name.

    The alias text is the key of the alias table, so it also breaks ties.
    """
    resolved = aliases.filter(F.col("canonical_node_id").isNotNull()).select(
        "alias_text", F.col("alias_text").alias("alias_key"), "canonical_name", "canonical_node_id"
    )
    best = top_similar(
        names, name, resolved, "alias_text", "alias_key", above=threshold - 1e-6, k=k
    )
    return best.drop("alias_text").join(resolved, "alias_key").drop("alias_key")


def _numbered(texts: DataFrame) -> DataFrame:
    """Distinct texts with a number; written once, without their trigrams, which need many times the room."""
    return stored(texts.filter("text IS NOT NULL").withColumn("id", F.monotonically_increasing_id()))


def _with_grams(texts: DataFrame) -> DataFrame:
    """Texts with their trigrams and how many there are."""
    d = texts.withColumn("grams", trigrams(F.col("text"))).filter(F.size("grams") > 0)
    return d.withColumn("size", F.size("grams"))


#: Names that must hold a word for it to be common; the other words of a name are its tail.
COMMON = 16


def _cores(names: DataFrame) -> DataFrame:
    """Adds ``core``, the trigrams of the words that many names share."""
    parts = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    flat = names.select("id", F.explode(F.array_distinct(parts)).alias("word"))
    common = flat.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).select("word")
    held = flat.join(common, "word").groupBy("id").agg(trigrams(F.array_join(F.collect_list("word"), " ")).alias("core"))
    return names.join(held, "id", "left").withColumn("core", F.coalesce("core", F.array().cast("array<string>")))


def _shared_grams(names: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``ranked``: numbers of the trigrams that the two sides share, those of few names first.

    ``size`` stays the whole size.  A trigram that only one side has can't be among the common ones of a pair.
    Names also have the two parts of their list, ``core`` and ``tail``; claims keep ``newest``.  Where names have few
    trigrams, claims look theirs up where they are read, and lists of shared ones are all that is shuffled and written.
    """
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = cut_lineage(_cores(cut_lineage(_with_grams(names))))
    own = names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("own"))
    own = cut_lineage(own.orderBy("own", "gram").select("gram", F.monotonically_increasing_id().alias("no")))
    few = own.count() <= BROADCAST_GRAMS
    known = F.broadcast(own) if few else own
    told = _with_grams(claims).select("id", "newest", "size", F.explode("grams").alias("gram")).join(known, "gram")
    told = stored(told.groupBy("id", "newest", "size").agg(F.array_sort(F.collect_list("no")).alias("ranked")))
    used = told.select(F.explode("ranked").alias("no")).distinct()
    known = cut_lineage(own.join(used, "no"))
    pairs = F.transform("grams", lambda g: F.struct(g.alias("gram"), F.array_contains("core", g).alias("common")))
    named = names.select("id", "size", F.inline(pairs)).repartition(n, "id").join(F.broadcast(known) if few else known, "gram")
    named = named.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("no", "common"))).alias("met"))
    numbers = lambda c: F.transform(c, lambda x: x["no"])
    return named.select(
        "id", "size", numbers("met").alias("ranked"), numbers(F.filter("met", lambda x: x["common"])).alias("core"),
        numbers(F.filter("met", lambda x: ~x["common"])).alias("tail")), told


def _near_pairs(
    names: DataFrame, claims: DataFrame, above: float, least: tuple[int, int], small: str | None, slack: int | None = None
) -> DataFrame:
    """Pairs of numbers with ratio > ``above``: l_id, r_id and what else the claims carry.

    A pair needs at least ``o = t (n + m) / (1 + t)`` common trigrams, so the first common one of either list lies
    among the first ``length - o + 1``; ``least`` is the smallest size on each side and shortens the lists
    before they are joined.  A pair is kept at its first common trigram and counted on the two rows at
    hand, so pairs are never grouped.  ``small`` names the side to be broadcast, if any.  With ``slack`` a name's
    list lacks up to ``most`` of its trigrams, ``slack`` at most: pairs that may reach the ratio with these come
    with ``sure``, whether they do without, l_n, r_n, both and the claim's list r.
    """
    share = F.lit(above / (1 + above))
    needed = lambda a, b, less: F.greatest(F.ceil(share * (a + b) - F.lit(1e-6)) - less, F.lit(1))

    def listed(d: DataFrame, side: str, other: int) -> DataFrame:
        less = F.col("most") if "most" in d.columns else F.lit(slack or 0)
        keep = (F.size("ranked") - needed(F.col("size"), F.lit(other), less) + 1).cast("int")
        rest = [F.col(c) for c in d.columns if c not in ("id", "size", "ranked")]
        return d.filter(keep > 0).select(
            F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_n"), F.col("ranked").alias(side), *rest,
            F.posexplode(F.slice("ranked", F.lit(1), keep)).alias(f"{side}_pos", "gram"))

    a, b = listed(names, "l", least[1]), listed(claims, "r", least[0])
    d = (F.broadcast(a) if small == "names" else a).join(F.broadcast(b) if small == "claims" else b, "gram")
    o = needed(F.col("l_n"), F.col("r_n"), F.lit(0) if slack is None else F.col("most"))
    d = d.filter((F.size("l") - F.col("l_pos") >= o) & (F.size("r") - F.col("r_pos") >= o))
    first = ~F.arrays_overlap(F.slice("l", F.lit(1), F.col("l_pos")), F.slice("r", F.lit(1), F.col("r_pos")))
    both = F.size(F.array_intersect("l", "r"))
    ratio = both / (F.col("l_n") + F.col("r_n") - both)
    rest = [c for c in claims.columns if c not in ("id", "size", "ranked")]
    if slack is not None:
        return d.filter(first & (both >= o)).select("l_id", "r_id", *rest, "l_n", "r_n", "r", both.alias("both"), (ratio > above).alias("sure"))
    return d.filter(first & (ratio > above)).select("l_id", "r_id", *rest)


def _kinds(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names with ``kind``, the number of those of equal core and size, and the kinds with the length of their longest tail."""
    kinds = named.groupBy("core", "size").agg(F.max(F.size("tail")).alias("most"))
    kinds = cut_lineage(kinds.withColumn("id", F.monotonically_increasing_id()))
    names = named.join(kinds.select("core", "size", F.col("id").alias("kind")), ["core", "size"]).select("id", "size", "kind", "tail", "ranked")
    return names, kinds.select("id", "size", F.col("core").alias("ranked"), "most")


def _newest_of_kinds(names: DataFrame, kinds: DataFrame, claims: DataFrame, above: float, k: int, spread: bool = True) -> DataFrame:
    """The ``k`` newest of ``claims`` that resemble each name: l_id, r_id, newest.  Few claims are ``spread`` over all tasks.

    Claims meet the common words once per kind.  What reaches the ratio with these alone resembles all names of the
    kind, so its ``k`` newest are enough; what a tail may lift to it meets the tails by their trigrams.  The rest
    shares nothing but the tail.
    """
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda d, c: d.agg(F.sum(F.size(c)), F.min("size"), F.count(F.lit(1))).first()
    newest = [F.col("newest").desc()]
    kinds = kinds.join(names.select(F.col("kind").alias("id")).distinct(), "id", "left_semi")
    n_claims, least, _ = count(claims, "ranked")
    out = []

    def meet(d: DataFrame, slack: int | None = None) -> DataFrame:
        grams, smallest, _ = count(d, "ranked")
        small = None if min(grams or 0, n_claims) > BROADCAST_GRAMS else "names" if (grams or 0) <= n_claims else "claims"
        sides = (d if small == "names" else d.repartition(n, "id"), claims.repartition(n, "id") if spread and small != "claims" else claims)
        return _near_pairs(*sides, above, (smallest or 0, least), small, slack)

    cored = kinds.filter(F.size("ranked") > 0)
    slack = cored.agg(F.max("most")).first()[0]
    if slack is not None:
        met = meet(cored, slack)
        met = cut_lineage(met) if slack else met
        best = top_per_key(met.filter("sure"), ["l_id"], newest, k).select(F.col("l_id").alias("kind"), "r_id", "newest")
        out.append(best.join(names.select("kind", F.col("id").alias("l_id")), "kind").select("l_id", "r_id", "newest"))
        if slack:
            open_ = met.filter("NOT sure").withColumnRenamed("l_id", "kind").select("*", F.posexplode("r").alias("pos", "gram"))
            tails = names.select(F.col("id").alias("l_id"), "kind", "tail", F.explode("tail").alias("gram"))
            few = (count(names, "tail")[0] or 0) <= BROADCAST_GRAMS
            if not few:
                # Few of a claim's trigrams are in any tail; only these take the shuffle.
                held = cut_lineage(tails.select("kind", "gram").distinct())
                open_ = open_.join(F.broadcast(held) if held.count() <= BROADCAST_GRAMS else held, ["kind", "gram"], "left_semi")
            d = open_.join(F.broadcast(tails) if few else tails, ["kind", "gram"])
            both = F.col("both") + F.size(F.array_intersect("tail", "r"))
            d = d.filter(~F.arrays_overlap(F.slice("r", F.lit(1), F.col("pos")), "tail") & (both / (F.col("l_n") + F.col("r_n") - both) > above))
            out.append(top_per_key(d.select("l_id", "r_id", "newest"), ["l_id"], newest, k))
    tailed = names.filter(F.size("tail") > 0).select("id", "size", F.col("tail").alias("ranked"))
    if not tailed.isEmpty():
        out.append(top_per_key(meet(tailed).select("l_id", "r_id", "newest"), ["l_id"], newest, k))
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    return top_per_key(found.distinct(), ["l_id"], newest, k)


#: Of claims from new to old, the numbers after which names that hold enough matches are set aside.
SLABS = (256, 2_048, 16_384)


def _newest_claims(names: DataFrame, claims: DataFrame, above: float, k: int) -> DataFrame:
    """The ``k`` newest resembling claims per name: l_id, r_id.

    ``claims`` holds ``newest``, the time and number of a claim's newest signal.  Claims are met from new to old in slabs.
    A name that has met ``k`` in newer slabs is finished, because all signals of later claims are older.
    """
    named, told = _shared_grams(names, claims)
    order = claims.select("id", "newest").orderBy(F.col("newest").desc()).limit(SLABS[-1])
    place = F.row_number().over(Window.orderBy(F.col("newest").desc()))
    slab = F.lit(0)
    for n in SLABS[:-1]:
        slab = slab + (F.col("place") > n).cast("int")
    slabs = order.withColumn("place", place).select("id", slab.alias("slab"))
    told = told.join(F.broadcast(cut_lineage(slabs)), "id", "left").fillna(len(SLABS), ["slab"])
    names_of, kinds = _kinds(cut_lineage(named))
    left, found = cut_lineage(names_of), None
    for number in range(len(SLABS) + 1):
        now = told.filter(F.col("slab") == number).drop("slab")
        if left.isEmpty():
            break
        # All that is left over lies in the files of its table already.
        now = now if number == len(SLABS) else cut_lineage(now)
        if now.isEmpty():
            continue
        met = _newest_of_kinds(left, kinds, now, above, k, spread=number < len(SLABS))
        found = cut_lineage(met if found is None else found.unionByName(met))
        full = found.groupBy("l_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        left = cut_lineage(left.join(full.select(F.col("l_id").alias("id")), "id", "left_anti"))
    if found is None:
        return names.select(F.col("id").alias("l_id"), F.col("id").alias("r_id")).limit(0)
    return top_per_key(found, ["l_id"], [F.col("newest").desc()], k).select("l_id", "r_id")


def signals_near_edges(
    edges: DataFrame,
    signals: DataFrame,
    *,
    above: float = 0.15,
    k: int = 30,
) -> DataFrame:
    """SIM-05: the ``k`` newest signals per edge whose claim resembles an endpoint name.

    ``edges`` holds edge_id, source_name, target_name; ``signals`` is already cut
    to the time window.  The newest ``k`` are cut per claim and per name before
    edges are joined, so an edge never meets all signals of a name.
    """
    pointed, lists = near_lists(edges, signals, above=above, k=k)
    return (
        pointed.join(lists, ["source", "target"])
        .select("edge_id", F.explode("near").alias("s"))
        .select("edge_id", "s.signal_id", "s.content_timestamp")
    )


def near_lists(edges: DataFrame, signals: DataFrame, *, above: float = 0.15, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """What :func:`signals_near_edges` joins: edge_id, source, target and the ``near`` signals of each such pair, newest first.

    Lists of signals have numbers; edges travel with two of them, and lists are merged once per pair.
    """
    newest = [F.col("content_timestamp").desc(), F.col("signal_id").desc()]
    sides = edges.select(F.explode(F.array("source_name", "target_name")).alias("name"))
    names = _numbered(sides.select(F.col("name").alias("text")).distinct())
    claims = _numbered(signals.groupBy(F.col("claim_text").alias("text")).agg(
        F.max(F.struct("content_timestamp", "signal_id")).alias("newest")))
    pairs = cut_lineage(_newest_claims(names, claims, above, k))
    ids = cut_lineage(pairs.select("r_id").distinct())
    texts = claims.select(F.col("id").alias("r_id"), F.col("text").alias("claim_text"))
    texts = cut_lineage(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_GRAMS else ids, "r_id"))
    met = signals.select("signal_id", "claim_text", "content_timestamp").join(
        F.broadcast(texts) if texts.count() <= BROADCAST_TEXTS else texts, "claim_text").drop("claim_text")
    per_claim = cut_lineage(top_per_key(met, ["r_id"], newest, k))
    per_name = top_per_key(pairs.join(per_claim, "r_id"), ["l_id"], newest, k)
    # At most k entries per name; many names share a list.
    lists = per_name.groupBy("l_id").agg(F.sort_array(F.collect_list(F.struct("content_timestamp", "signal_id")), asc=False).alias("near"))
    lists = cut_lineage(lists.join(names.select(F.col("id").alias("l_id"), F.col("text").alias("name")), "l_id").drop("l_id"))
    kinds = cut_lineage(lists.select("near").distinct().withColumn("no", F.monotonically_increasing_id()))
    of_name = cut_lineage(lists.join(kinds, "near").select("name", "no"))
    pointed = edges.select("edge_id", "source_name", "target_name")
    for end in ("source", "target"):
        pointed = pointed.join(of_name.select(F.col("name").alias(f"{end}_name"), F.col("no").alias(end)), f"{end}_name", "left")
    pointed = pointed.filter("source IS NOT NULL OR target IS NOT NULL").select("edge_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("source", "target")])
    pointed = cut_lineage(pointed)
    both = pointed.select("source", "target").distinct()
    for end in ("source", "target"):
        both = both.join(kinds.select(F.col("no").alias(end), F.col("near").alias(f"near_{end}")), end, "left")
    none = F.array().cast(lists.schema["near"].dataType)
    merged = F.array_union(F.coalesce("near_source", none), F.coalesce("near_target", none))
    return pointed, both.select("source", "target", F.slice(F.sort_array(merged, asc=False), 1, k).alias("near"))
