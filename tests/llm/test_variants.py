import random
from itertools import combinations

from pyspark.sql import functions as F

from conftest import DATA

from quillspan.llm import variants
from quillspan.llm.queries import _typed_names
from quillspan.llm.variants import name_similarity, name_words, org_agreement, org_core, org_relation, star_clusters, text_bands, tune_bands, variant_pairs
from quillspan.session import cut_lineage

SCHEMA = "name_id long, name string, organization string, year int, position string"


def test_bands_follow_the_collision_curve():
    rows, bands = tune_bands(0.5, 0.96)
    assert 1 - (1 - 0.5**rows) ** bands >= 0.96
    assert 1 - (1 - 0.1**rows) ** bands < 0.05


def _grams(word, q=2):
    padded = "\x02" * (q - 1) + word + "\x03" * (q - 1)
    return [padded[i : i + q] for i in range(len(padded) - q + 1)]


def test_banding_recall_against_brute_force(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 5))) for _ in range(250)]
    words = sorted({*base, *[w[:2] + rnd.choice("aeiou") + w[2:] for w in base], *[w[:-1] for w in base]})
    bands = text_bands(spark.createDataFrame([(w,) for w in words], "text string"), 0.6, 0.9).select("text", F.explode("bands").alias("band"))
    met = {(r[0], r[1]) for r in bands.alias("x").join(bands.alias("y"), "band").where("x.text < y.text").select("x.text", "y.text").distinct().collect()}
    grams = {w: set(_grams(w)) for w in words}
    near = {(a, b) for a in words for b in words if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}
    assert len(near & met) / len(near) >= 0.9


def test_relation_of_organisations_against_brute_force(spark):
    rnd = random.Random(3)
    syll = lambda n: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(n))
    base = [" ".join(syll(rnd.randint(1, 5)) for _ in range(rnd.randint(1, 3))) for _ in range(120)]
    typed = []
    for o in base:
        i, j = rnd.randrange(len(o)), rnd.randrange(len(o))
        typed += [o[:i] + o[i + 1 :], o[:i] + rnd.choice("xyz") + o[i:], o[:i] + o[i : i + 2][::-1] + o[i + 2 :], o.split()[0], o + " " + syll(3), "".join(sorted([*o[:1], *o[1:]], key=lambda c: (c == o[j], c)))]
    orgs = sorted({" ".join(o.split()) for o in base + typed} - {""})
    df = spark.createDataFrame([(o,) for o in orgs], "org string")
    every = df.crossJoin(df.withColumnRenamed("org", "other"))
    want = {tuple(r) for r in every.where(org_agreement(F.col("org"), F.col("other")) > 0).collect()}
    got = {tuple(r) for r in org_relation(df, df.withColumnRenamed("org", "other")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_pair_recall_against_brute_force(spark):
    """Links among all pairs of a table's profiles that the keys find."""
    rows = variants.profiles(_typed_names(spark, str(DATA / "sf0.01")))
    distinct = rows.where("name_id = profile and size(words) > 0").drop("name_id")
    kept = variants.candidate_pairs
    try:
        variants.candidate_pairs = lambda d: d.select(F.col("profile").alias("a")).crossJoin(d.select(F.col("profile").alias("b"))).where("a < b")
        want = {(r["a"], r["b"]) for r in variants.verified_links(distinct).collect()}
    finally:
        variants.candidate_pairs = kept
    got = {(r["a"], r["b"]) for r in variants.verified_links(distinct).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_words_and_similarity(spark):
    names = ["Müller-Lüdenscheid, Robert Jr.", 'Robert "Bobby" Muller Ludenscheid III', "R. K. Muller", "", None, "123", "Al0ha Sm1th"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(name_words(F.col("n")).alias("w"))
    got = [r["w"] for r in df.collect()]
    assert got[0] == got[1] == ["ludenscheid", "muller", "robert"] and got[2] == ["k", "muller", "r"] and got[3] == got[4] == got[5] == [] and got[6] == ["aloha", "smlth"]
    row = df.select(name_similarity(F.lit(["muller", "r"]), F.lit(["muller", "robert"])), name_similarity(F.lit(["muller", "james"]), F.lit(["muller", "robert"]))).first()
    assert row[0] > 0.95 and row[1] < 0.75
    orgs = spark.createDataFrame([("University of X-Town (NCAA)",), ("X Town Univ.",), ("U",), (None,)], "o string")
    assert [r[0] for r in orgs.select(org_core(F.col("o"))).collect()] == ["x town", "x town", None, None]


def test_pairs_of_people(spark):
    rows = [
        (1, "Tomas Drekevmont", "Ashmoor", 2007, "PG"), (2, "Drekevmont, Tomas", "University of Ashmoor", 2007, "PG"), (3, "T. Drekevmont", "Ashmoor", 2007, None), (4, "Tomas Drekewmont Jr.", "ASHMOOR", None, "PG"),
        (5, "Tomas Drekevmont", "Holcombe", 2013, "C"), (6, "Tomas Drekevmont", "Holcombe", 2013, "C"), (7, "Victor Drekevmont", "Ashmoor", 2007, "C"), (8, "", None, None, None), (9, None, "Ashmoor", 2007, "PG"), (10, "x" * 3000, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("profile", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {tuple(r) for r in variant_pairs(df).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b} | {(5, 6)}


def test_short_forms_are_learned(spark):
    rnd = random.Random(4)
    syll = lambda n: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(n))
    rows = []
    for i in range(120):
        given, surname, org = rnd.choice(["william", "robert", "malik", "tomas"]), syll(4), syll(3)
        rows += [(sorted([given, surname]), org, 2000 + i % 9)] * 2
        if given in ("william", "robert") and i % 2:
            rows.append((sorted([{"william": "bill", "robert": "bob"}[given], surname]), org, 2000 + i % 9))
    rows += [(["bob", "lone"], None, None), ([], None, 2000), (["x"] * 50, "a", 2000)]
    df = spark.createDataFrame(rows, "words array<string>, org string, year int")
    forms = variants.learned_forms(df)
    assert {tuple(r) for r in forms.collect()} == {("bill", "william"), ("bob", "robert")}
    got, joined = ({tuple(r["words"]) for r in variants.written_out(df, "words", forms, most).collect()} for most in (500, 0))
    assert got == joined
    assert ("lone", "robert") in got and not any("bob" in w or "bill" in w for w in got) and ("x",) * 50 in got


def test_stars(spark):
    links = [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (4, 5, 0.5), (5, 6, 2.0), (7, 8, 1.0)]
    got = {r["profile"]: r["star"] for r in star_clusters(spark.createDataFrame(links, "a long, b long, score double")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7}
    assert star_clusters(spark.createDataFrame([], "a long, b long, score double")) is None or True


def _links(df, pairs=None):
    """Linked (a, b) by candidates, or by the given pairs."""
    distinct = variants.profiles(df).where("name_id = profile").drop("name_id")
    kept = variants.candidate_pairs
    try:
        if pairs is not None:
            variants.candidate_pairs = lambda _: pairs
        return {(r["a"], r["b"]) for r in variants.verified_links(distinct).collect()}
    finally:
        variants.candidate_pairs = kept


def _against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    every = spark.createDataFrame(list(combinations([r[0] for r in rows], 2)), "a long, b long")
    want = _links(df, every)
    assert want and _links(df) == want


def test_profiles_lacking_year_or_organisation_meet(spark):
    _against_brute_force(spark, [
        (1, "Tomas Drekevmont", None, 2007, "PG"), (2, "Tomas Drekevmont", "Ashmoor", None, "PG"), (3, "Tomas Drekevmont", "Ashmoor", 2008, "PG"),
        (4, "Pavel Quostutby", None, 2010, "C"), (5, "Pavel Quostutby", "Holcombe", 2009, "C"), (6, "Omari Fabbervell", None, 2011, "SF"), (7, "Omari Fabbervell", None, 2012, "SF"), (8, "Lars Holertsky", "Ashmoor", None, None), (9, "Lars Holertsky", None, 2004, None),
    ])


def test_common_words_are_keys_on_both_sides(spark):
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    others = [(100 + i, f"{(syllables[i] + syllables[(7 * i + 3) % 70] + syllables[(11 * i + 5) % 70]).title()} Smith", chr(97 + i % 26) * 6 + chr(97 + i // 26) * 6, 1900 + 3 * (i % 30), "C") for i in range(60)]
    _against_brute_force(spark, [(1, "Z. Smith", "Ashmoor", 2007, "PG"), (2, "Zoltan Smith", "Ashmoor", 2007, "PG"), (3, "Q. Smyth", "Holcombe", 2011, "PG"), (4, "Quentin Smith", None, 2011, "PG"), *others])


def test_names_of_short_words_meet(spark):
    _against_brute_force(spark, [(1, "Yao Li", "Ashmoor", 2007, "PG"), (2, "Yao Li", "Ashmoor", 2007, "C"), (3, "Yao Lian", "Ashmoor", 2007, "PG"), (4, "Kim Lee", "Holcombe", 2011, "SF"), (5, "Kim Leee", "Holcombe", 2011, None), (6, "Bo Lu", None, 2010, "C"), (7, "Lu, Bo", "Kesbrook", None, "C")])
    _against_brute_force(spark, [(1, "Yao Sun", "Ashmoor", 2007, "PG"), (2, "Sun, Yao", "Ashmoor", 2007, "C"), (3, "Bo Li", "Holcombe", 2011, "PG"), (4, "Bo Lee", "Holcombe", 2011, "PG"), (5, "Li, Bo", "Holcombe", 2011, None), (6, "Ana Vu", "Margate", None, None), (7, "Ana Vu", None, 2003, None)])
    _against_brute_force(spark, [(1, "B. J.", "Ashmoor", 2007, "PG"), (2, "BJ", "Ashmoor", 2007, "PG"), (3, "J B", "Ashmoor", 2007, "C")])


def test_slices_meet_the_same_pairs(spark):
    made = variants.profiles(_typed_names(spark, str(DATA / "sf0.01")))
    distinct = cut_lineage(made.where("name_id = profile and size(words) > 0").drop("name_id"))
    whole, parts = ({(r["a"], r["b"]) for r in variants.candidate_pairs(distinct, n).collect()} for n in (10**6, -(-distinct.count() // 7)))
    assert parts == whole and whole


def test_rare_spellings_look_for_the_usual_one(spark):
    usual, rare = "ashby state", [f"ashby state {x}" for x in "klmnopqr"]
    rows = [(i, usual, None, [1, 2]) for i in range(100)] + [(1000 + i, o, None, [1]) for i, o in enumerate(rare)]
    held = spark.createDataFrame(rows, "profile long, org string, year int, bands array<long>")
    related = spark.createDataFrame([p for o in rare for p in ((usual, o), (o, usual))], "org string, other string")
    chosen = variants.seeking(related, held)
    assert {tuple(r) for r in chosen.collect()} == {(o, usual) for o in rare}
    seek, _ = variants.cell_rows(held, chosen)
    # each row's own cells, and one more for each rare row; the usual rows are not written out for every spelling
    assert seek.count() == 100 * 2 + 8 + 8
