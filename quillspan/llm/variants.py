"""Variant spellings of names: MinHash banding, Monge-Elkan verification, star clustering.

Rows are collapsed to profiles (words of the name, organisation, year, position).  A distinct
word is a set of padded q-grams, weighed by their rarity in all words, and gets
bands of a weighted MinHash; rows per band and the number of bands are taken from the
collision curve, so that words of a given similarity meet with a given recall.  A key of a
profile is a band of a word with the initial of another, so each full word of a name is a chance to
meet and an abbreviated one costs none.

Verification refuses pairs whose organisations are both known and unlike, and pairs without a
common organisation whose years are both known and more than one apart.  So a band only has to be compared
where one of these holds, and these cells lose nothing that verification would accept:

* both organisations known: inside one organisation or one that agrees with it (the relation of
  organisations is found among their distinct names);
* an organisation missing: inside the same year and those next to it;
* an organisation and a year missing: over all names.

No word is too short, too long or too common to be a key, and nothing depends on the number of rows.
Short forms of given names are not listed but learned: words that often stand beside the same surname in one
organisation and year.
Pairs are verified by Monge-Elkan similarity of the names and by their attributes, and links
become stars around the best connected profiles.

Only bands and narrow keys move; no list of a bucket is ever gathered.  Defined results: a
name without letters links to nothing; a name of single letters is compared with its like only; a text of more than MOST_WORDS words is no name and is
linked to equal texts only; null attributes neither speak for nor against; equal
rows are one profile and always linked; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.scalars import NAME_SUFFIXES, fold_accents
from quillspan.session import cut_lineage, release

# Words of an organisation's name that do not tell it from others.
ORG_WORDS = ("university", "univ", "of", "u", "ncaa", "the", "college", "club", "bc", "kk", "fc")


#: Texts of more words are not compared as names.
MOST_WORDS = 40


def name_words(name: Column) -> Column:
    """Lower-case words of a typed name, in order: no accents, suffixes or quoted nicknames; look-alike
    digits inside words are letters."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), "[\"“”(][^\"“”()]*[\"“”)]", " ")
    text = F.lower(fold_accents(text))
    text = F.regexp_replace(text, "['’`]", "")
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " ")
    words = F.filter(F.transform(words, lambda w: F.when(w.rlike(r"\p{L}"), F.translate(w, "013458", "oleasb")).otherwise(w)), lambda w: w.rlike(r"\p{L}"))
    kept = F.filter(words, lambda w: ~w.isin(*NAME_SUFFIXES) | (F.length(w) == 1))
    return F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(words))


def org_core(name: Column) -> Column:
    """Words of an organisation without those that all share; null when none is left, or more than
    MOST_WORDS (no name of an organisation)."""
    text = F.regexp_replace(F.lower(fold_accents(name)), r"[^\p{L}\p{N}]+", " ")
    words = F.filter(F.split(F.trim(text), " "), lambda w: (w != "") & ~w.isin(*ORG_WORDS))
    return F.when(F.size(words) <= MOST_WORDS, F.nullif(F.array_join(words, " "), F.lit("")))


def tune_bands(similarity: float, recall: float, crowd: float = 0.15, max_hashes: int = 90) -> tuple[int, int]:
    """(rows, bands) with the wanted recall at ``similarity`` and the fewest collisions at ``crowd``."""
    best = None
    for rows in range(1, 9):
        hit = similarity**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if rows * bands <= max_hashes:
            noise = 1 - (1 - crowd**rows) ** bands
            if best is None or noise < best[0]:
                best = noise, rows, bands
    if best is None:
        raise ValueError("no banding within max_hashes reaches that recall")
    return best[1], best[2]


def _gram_hashes(text: Column, q: int) -> Column:
    """Hashes of the distinct padded q-grams of a text's words."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("\x02" * (q - 1)), word, F.lit("\x03" * (q - 1)))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.xxhash64(F.substring(padded, i, F.lit(q))))

    return F.array_distinct(F.flatten(F.transform(F.split(text, " "), of)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def text_bands(texts: DataFrame, similarity: float = 0.55, recall: float = 0.95, q: int = 2, seed: int = 5, cells: int = 1 << 16, max_hashes: int = 90) -> DataFrame:
    """(text, bands) by weighted MinHash; ``texts``: (text) without repeats, none of them empty.

    A q-gram's weight is its rarity.  Counts are kept in ``cells`` cells of q-grams' hashes, so
    what is sent to the tasks has that size whatever the alphabet.
    """
    rows, bands = tune_bands(similarity, recall, max_hashes=max_hashes)
    hashed = cut_lineage(texts.select("text", _gram_hashes(F.col("text"), q).alias("grams")))
    counts = hashed.select(F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(cells)).alias("cell")).agg(F.count("*").alias("n")).collect()
    total = max(1, hashed.count())
    rarity = np.full(cells, math.log(1 + total))
    for r in counts:  # at most ``cells`` rows
        rarity[r["cell"]] = math.log(1 + total / r["n"])
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, salts = shared.value, np.random.default_rng(seed).integers(1, 2**63, rows * bands).astype(np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            lists = batch["grams"].tolist()
            flat = np.concatenate(lists).astype(np.int64)
            starts = np.cumsum([0, *[len(x) for x in lists[:-1]]])
            scale, h = -1.0 / weights[flat % cells], flat.view(np.uint64)
            key = np.repeat(salts[::rows][:, None], len(lists), axis=1)
            for k, salt in enumerate(salts):
                # exponential draws: the least is each q-gram's in proportion to its weight
                draw = np.log(((_mix(h ^ salt) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * scale
                key[k // rows] = _mix(key[k // rows] ^ np.minimum.reduceat(draw, starts).view(np.uint64))
            yield pd.DataFrame({"text": batch["text"], "bands": list(np.ascontiguousarray(key.T).view(np.int64))})

    return hashed.mapInPandas(sign, "text string, bands array<long>")


def word_similarity(a: Column, b: Column) -> Column:
    """1 for equal words, 0.9 for initials and beginnings, else by edits."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    starts = a.startswith(b) | b.startswith(a)
    return (
        F.when(a == b, 1.0)
        .when(shorter == 1, F.when(starts, 0.9).otherwise(0.0))
        .when(starts & (shorter >= 3), 0.9)
        .otherwise(1.0 - F.levenshtein(a, b) / longer)
    )


def monge_elkan(a: Column, b: Column) -> Column:
    """Mean over the words of ``a`` of the best similarity to a word of ``b``.

    Words weigh by their length, but an initial as four letters: it stands for a word.
    """
    weight = lambda w: F.when(F.length(w) == 1, 4).otherwise(F.length(w))
    total = F.aggregate(a, F.lit(0.0), lambda s, w: s + weight(w))
    got = F.aggregate(a, F.lit(0.0), lambda s, w: s + weight(w) * F.array_max(F.transform(b, lambda v: word_similarity(w, v))))
    return got / F.nullif(total, F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """Monge-Elkan of the name with fewer letters against the other."""
    letters = lambda x: F.length(F.array_join(x, ""))
    return F.when(a == b, 1.0).when(letters(a) <= letters(b), monge_elkan(a, b)).otherwise(monge_elkan(b, a))


def unlike_words(a: Column, b: Column) -> Column:
    """Whether more words (of three letters or more) are unlike all of the other name's than the
    difference of their numbers explains.

    Else one initial could stand for several words, a middle initial for another surname, or two
    like words of one name for one word of the other.
    """
    full = lambda x: F.filter(x, lambda w: F.length(w) >= 3)
    alone = lambda x, y: F.size(F.filter(full(x), lambda w: ~F.exists(full(y), lambda v: word_similarity(w, v) >= 0.6)))
    more = lambda x, y: F.greatest(F.lit(0), F.size(full(x)) - F.size(full(y)))
    return (alone(a, b) > more(a, b)) | (alone(b, a) > more(b, a))


def org_agreement(a: Column, b: Column) -> Column:
    """2 for like organisations, -3 for others, 0 where one is unknown.

    The shorter name decides by its words; one edit in six letters or two swapped letters pass.
    """
    shorter = F.least(F.size(F.split(a, " ")), F.size(F.split(b, " ")))
    head = lambda x: F.array_join(F.slice(F.split(x, " "), 1, shorter), " ")
    x, y = head(a), head(b)
    edits = F.levenshtein(x, y)
    letters = lambda t: F.array_sort(F.split(t, ""))
    like = (edits <= F.greatest(F.lit(1), F.floor(F.least(F.length(x), F.length(y)) / 6))) | (edits == 2) & (letters(x) == letters(y))
    begins = F.concat(a, F.lit(" ")).startswith(F.concat(b, F.lit(" "))) | F.concat(b, F.lit(" ")).startswith(F.concat(a, F.lit(" ")))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 2.0).when(begins, 2.0).when(like, 2.0).otherwise(-3.0)




def _no_keys() -> Column:
    return F.array().cast("array<bigint>")


def one_less(text: Column) -> Column:
    """Hashes of the text and of its forms with one letter less."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.xxhash64(F.concat(F.substring(text, F.lit(1), i), F.substring(text, i + 2, F.length(text)))))


def org_relation(orgs: DataFrame, others: DataFrame) -> DataFrame:
    """(org, other) of organisations that agree, found among their distinct names.

    ``orgs``: (org), ``others``: (other), without repeats or nulls.  What agrees is the beginning of one
    with as many words as the other has.  Beginnings one edit or one swap of neighbours apart share
    a form with one letter less, beginnings of the same letters share these, and two edits pass in
    long beginnings only, whose bands meet.
    """
    heads = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda i: F.array_join(F.slice(F.split(c, " "), 1, i), " "))).alias("text"))
    left, right = heads(orgs, "org"), heads(others, "other")
    texts = cut_lineage(left.select("text").union(right.select("text")).distinct())
    bands = text_bands(texts.where("length(text) >= 12"), 0.55, 0.95)
    letters = F.array(F.xxhash64(F.lit("letters"), F.array_join(F.array_sort(F.split("text", "")), "")))
    bands = texts.join(bands, "text", "left").select("text", F.array_distinct(F.concat(F.coalesce("bands", _no_keys()), one_less(F.col("text")), letters)).alias("bands"))
    bands = cut_lineage(bands)
    keyed = lambda df, c: df.join(bands, "text").select(c, (F.col(c) == F.col("text")).alias(f"whole_{c}"), F.explode("bands").alias("band"))
    # one of the two is compared as a whole
    met = cut_lineage(keyed(left, "org").join(keyed(right, "other"), "band").where("whole_org or whole_other").select("org", "other").distinct())
    return cut_lineage(met.where(org_agreement(F.col("org"), F.col("other")) > 0))


def year_agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.5).when(F.abs(a - b) == 1, 0.5).otherwise(-1.5)


def position_agreement(a: Column, b: Column) -> Column:
    parts = F.arrays_overlap(F.split(a, "-"), F.split(b, "-"))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 0.7).when(parts, 0.3).otherwise(-1.0)


def learned_forms(names: DataFrame, least: int = 3, share: float = 0.15) -> DataFrame:
    """(word, full) of short and other forms of given names, learned from the names themselves.

    ``names``: words, org, year.  Two words are forms of each other if they often stand beside the same other
    word in the same organisation and year: in ``least`` such places with different other words or more, and
    in ``share`` of all places of the rarer one.  A word follows the form it shares most places with, if that has more places.
    """
    two = names.where("size(words) = 2 and org is not null and year is not null")
    sides = F.explode(F.array(*[F.struct(F.col("words")[i].alias("word"), F.col("words")[1 - i].alias("beside")) for i in (0, 1)])).alias("s")
    places = two.select("org", "year", sides).select("org", "year", "s.*").where("length(word) >= 2 and length(beside) >= 3").distinct()
    places = cut_lineage(places)
    counts = places.groupBy("word").agg(F.count("*").alias("n"))
    met = places.join(places.withColumnRenamed("word", "full"), ["org", "year", "beside"]).where("word <> full")
    found = met.groupBy("word", "full").agg(F.count("*").alias("both"), F.countDistinct("beside").alias("others"))
    found = found.where(F.col("others") >= least).join(counts, "word").join(counts.select(F.col("word").alias("full"), F.col("n").alias("n_full")), "full")
    found = found.where((F.col("both") >= share * F.col("n")) & (F.col("n_full") > F.col("n")))
    return cut_lineage(found.groupBy("word").agg(F.max_by("full", F.struct("both", "full")).alias("full")))


def written_out(df: DataFrame, words: str, forms: DataFrame, most_inline: int = 500) -> DataFrame:
    """``df`` with the short forms (word, full) in its arrays of sorted words written out.

    Up to ``most_inline`` forms are part of the expression; more are joined, to the names that hold one.
    A text of more than MOST_WORDS words stays as it is.
    """
    few = forms.limit(most_inline + 1).collect()
    if len(few) <= most_inline:
        if not few:
            return df
        known = F.create_map(*[F.lit(x) for r in few for x in (r["word"], r["full"])])
        full = F.array_sort(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)))
        return df.withColumn(words, F.when(F.size(words) <= MOST_WORDS, full).otherwise(F.col(words)))
    held = df.where(F.size(words) <= MOST_WORDS).select(words).distinct().select(words, F.explode(F.array_distinct(words)).alias("word"))
    held = held.join(forms, "word").groupBy(words).agg(F.map_from_entries(F.collect_list(F.struct("word", "full"))).alias("_forms"))
    full = F.array_sort(F.transform(words, lambda w: F.coalesce(F.try_element_at("_forms", w), w)))
    return df.join(held, words, "left").withColumn(words, F.when(F.col("_forms").isNotNull(), full).otherwise(F.col(words))).drop("_forms")


def profiles(rows: DataFrame) -> DataFrame:
    """(name_id, profile, words, org, year, position); ``profile`` is its smallest name_id.

    ``rows``: name_id, name, organization, year, position.
    """
    made = rows.select("name_id", name_words(F.col("name")).alias("words"), org_core(F.col("organization")).alias("org"), F.col("year").cast("int").alias("year"), F.nullif(F.upper(F.trim("position")), F.lit("")).alias("position"))
    made = cut_lineage(made)
    made = written_out(made, "words", learned_forms(made))
    parts = [F.array_join("words", " "), *[F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in ("org", "year", "position")]]
    made = made.withColumn("key", F.concat_ws("\x1f", *parts))
    least = made.groupBy("key").agg(F.min("name_id").alias("profile"))
    return cut_lineage(made.join(least, "key").select("name_id", "profile", "words", "org", "year", "position"))


def _keyed(distinct: DataFrame) -> DataFrame:
    """(profile, org, year, keys) of each word of two letters or more.

    A key is a band of the word with an initial of another word (none in a name of one word).
    A name of single letters is keyed as one word.
    """
    words = distinct.select("profile", "org", "year", "words", F.posexplode("words").alias("at", "text")).where("length(text) >= 2")
    others = F.array_distinct(F.filter(F.transform("words", lambda w: F.substring(w, 1, 1)), lambda x, i: i != F.col("at")))
    words = words.select("profile", "org", "year", "text", F.when(F.size(others) > 0, others).otherwise(F.array(F.lit(""))).alias("initials"))
    letters = distinct.where(~F.exists("words", lambda w: F.length(w) >= 2)).select("profile", "org", "year", F.array_join("words", "").alias("text"), F.array(F.lit("")).alias("initials"))
    words = words.unionByName(letters)
    texts = cut_lineage(words.select("text").distinct())
    # two words are two chances, hence less recall for each; short words have few q-grams: those one edit
    # apart share a form with one letter less
    bands = texts.join(text_bands(texts.where("length(text) >= 6"), 0.6, 0.85, max_hashes=30), "text", "left")
    bands = bands.select("text", F.concat(F.coalesce("bands", _no_keys()), F.when(F.length("text") <= 7, one_less(F.col("text"))).otherwise(_no_keys())).alias("bands"))
    keys = F.array_distinct(F.flatten(F.transform("initials", lambda i: F.transform("bands", lambda b: F.xxhash64(b, i)))))
    return cut_lineage(words.join(bands, "text").select("profile", "org", "year", keys.alias("bands")))


def seeking(related: DataFrame, rows: DataFrame) -> DataFrame:
    """(org, other) of the related organisations, one way for each two: the one with fewer ``rows`` (org) seeks.

    A rare spelling looks into the usual one's cells; the other way, all its rows would be written out
    for each of its spellings.
    """
    n = rows.groupBy("org").agg(F.count("*").alias("n"))
    both = related.join(n, "org").join(n.select(F.col("org").alias("other"), F.col("n").alias("n_other")), "other")
    return both.where("n < n_other or n = n_other and org < other").select("org", "other")


def cell_rows(held: DataFrame, related: DataFrame, slices: int = 1, at: int = 0) -> tuple[DataFrame, DataFrame]:
    """(seek, index): (profile, cell, own) of the profiles that look for others, and of those to be found.

    Slice ``at`` has the cells of some organisations and years; what is compared over all names is cut by bands.
    """

    def cells(rows: DataFrame, kind: str, within: str | None = None, own: bool = False) -> DataFrame:
        w = F.struct(F.lit(kind)) if within is None else F.struct(F.lit(kind), F.col(within))
        mine = lambda x: F.pmod(F.xxhash64(F.lit("slice"), x), F.lit(slices)) == at
        if slices > 1 and within:
            rows = rows.where(mine(w))
        rows = rows.select("profile", F.explode("bands").alias("band"), w.alias("w"))
        if slices > 1 and not within:
            rows = rows.where(mine(F.col("band")))
        return rows.select("profile", F.xxhash64("w", "band").alias("cell"), F.lit(own).alias("own"))

    placed, dated = held.where("org is not null"), held.where("year is not null")
    lone, bare = held.where("org is null and year is not null"), held.where("org is null and year is null")
    near = lone.withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
    index = [cells(placed, "org", "org"), cells(dated, "year", "year"), cells(held, "all"), cells(held.where("year is null and org is not null"), "undated")]
    sought = held.join(related, "org").select("profile", F.col("other").alias("org"), "bands")
    seek = [cells(placed, "org", "org", own=True), cells(sought, "org", "org"), cells(near, "year", "year"), cells(bare, "all"), cells(lone, "undated")]
    return reduce(DataFrame.unionByName, seek), reduce(DataFrame.unionByName, index)


def _met(seek: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b), a < b, that share a cell; no frame with the shuffles behind it is left after this."""
    met = seek.withColumnRenamed("profile", "a").join(index.select("cell", F.col("profile").alias("b")), "cell").where("a < b or not own and a <> b")
    return cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


#: Profiles whose cells are joined at a time; each slice's shuffles are off the disk before the next.
SLICE = 200_000


def candidate_pairs(distinct: DataFrame, slice_rows: int = SLICE, most: int = 16) -> DataFrame:
    """(a, b), a < b, of profiles with a like word whose organisation or year may agree."""
    held = _keyed(distinct)
    orgs = held.where("org is not null").select("org").distinct()
    related = cut_lineage(seeking(org_relation(orgs, orgs.withColumnRenamed("org", "other")), held.where("org is not null")))
    slices = max(1, min(most, -(-distinct.count() // slice_rows)))
    made = []
    for i in range(slices):
        release(distinct.sparkSession, settle=3.0 if i else 0.0)
        made.append(_met(*cell_rows(held, related, slices, i)))
    release(distinct.sparkSession)
    # pairs without organisation may meet in several slices
    return made[0] if slices == 1 else reduce(DataFrame.unionByName, made).distinct()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however many filters use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def verified_links(distinct: DataFrame, least_name: float = 0.8, least_score: float = 0.9) -> DataFrame:
    """(a, b, score) of profile pairs whose names are alike and whose attributes agree."""
    p = distinct.select("profile", "words", "org", "year", "position")
    full = F.size(F.filter("words", lambda w: F.length(w) >= 3))
    x = p.select(*[F.col(c).alias(f"{c}_a") for c in p.columns], full.alias("full_a"))
    y = p.select(*[F.col(c).alias(f"{c}_b") for c in p.columns], full.alias("full_b"))
    met = candidate_pairs(distinct).join(x, F.col("a") == F.col("profile_a")).join(y, F.col("b") == F.col("profile_b"))
    other = org_agreement(F.col("org_a"), F.col("org_b")) + year_agreement(F.col("year_a"), F.col("year_b")) + position_agreement(F.col("position_a"), F.col("position_b"))
    met = once(met, other=other).where("other > -1.0")
    met = once(met, name=name_similarity(F.col("words_a"), F.col("words_b")))
    # more typos pass where organisation and year both agree, fewer where years or positions disagree
    against = (year_agreement(F.col("year_a"), F.col("year_b")) < 0).cast("int") + (position_agreement(F.col("position_a"), F.col("position_b")) < 0).cast("int")
    met = met.where(F.col("name") >= F.when(F.col("other") >= 3.0, least_name - 0.08).otherwise(least_name + 0.1 * against))
    exact = F.when(F.col("words_a") == F.col("words_b"), 1.0).when(F.least("full_a", "full_b") >= 2, 0.5).otherwise(0.0)
    scored = once(met, score=F.col("other") + exact + 5 * (F.col("name") - 0.9)).where(F.col("score") >= least_score)
    return scored.where(~unlike_words(F.col("words_a"), F.col("words_b"))).select("a", "b", "score")


def star_clusters(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(profile, star): centres are the best connected profiles, their links' ends the points.

    Per round, every free profile that beats all its free neighbours (degree, then id) is a
    centre and takes its free neighbours; a profile wanted by several goes with the best score.
    Profiles left without free neighbours are stars of their own.
    """
    both = cut_lineage(links.select("a", "b", "score").union(links.select("b", "a", "score")))
    degree = both.groupBy("a").agg(F.count("*").alias("deg"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("deg").alias("deg_b")), "b")
    live = cut_lineage(ranked.select("a", "b", "score", F.struct("deg", -F.col("a")).alias("rank_a"), F.struct(F.col("deg_b").alias("deg"), -F.col("b")).alias("rank_b")))
    done = None
    for _ in range(max_rounds):
        release(links.sparkSession)
        centre = live.groupBy("a").agg(F.max("rank_b").alias("best"), F.first("rank_a").alias("own")).where("own > best").select(F.col("a").alias("star"))
        taken = live.join(centre, live.a == centre.star).groupBy("b").agg(F.max_by("star", F.struct("score", "rank_a")).alias("star")).select(F.col("b").alias("profile"), "star")
        found = cut_lineage(taken.union(centre.select("star", "star")))
        done = found if done is None else done.union(found)
        gone = found.select(F.col("profile").alias("a"))
        live = cut_lineage(live.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select(*live.columns))
        if live.isEmpty():
            return _attach(both, done)
    raise RuntimeError(f"stars still change after {max_rounds} rounds")


def _attach(both: DataFrame, stars: DataFrame) -> DataFrame:
    """Profiles whose neighbours all went to other stars follow their best link."""
    left = both.join(stars.select(F.col("profile").alias("a")), "a", "left_anti")
    best = left.join(stars, left.b == stars.profile).groupBy("a").agg(F.max_by("star", F.struct("score", -F.col("star"))).alias("star"))
    return cut_lineage(stars.union(best.select("a", "star")))


def named_alike(rows: DataFrame) -> DataFrame:
    """(name_id, cluster) of all rows with a name; ``cluster`` is a profile's id."""
    made = profiles(rows).where("size(words) > 0")
    release(made.sparkSession)
    distinct = made.where(f"name_id = profile and size(words) <= {MOST_WORDS}").drop("name_id")
    stars = star_clusters(verified_links(distinct))
    return made.join(stars, "profile", "left").select("name_id", F.coalesce("star", "profile").alias("cluster"))


def variant_pairs(rows: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b), a < b, of the rows naming one person."""
    found = cut_lineage(named_alike(rows))
    release(found.sparkSession)
    other = found.select(F.col("name_id").alias("name_id_b"), "cluster")
    return found.withColumnRenamed("name_id", "name_id_a").join(other, "cluster").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
