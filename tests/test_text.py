import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from terralex.functions import text as T
from terralex.operators import filters, fuzzy, resolve


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "name,strip,want",
    [
        ("Place du Pont Neuf", True, "pontneuf"),
        ("Rue de la Porte Jaune", True, "portejaune"),
        ("Rue de la Porte Jaune", False, "ruedelaportejaune"),
        ("porte jaune", False, "portejaune"),
        ("Rue du 8 Mai 1945", True, "huitmaimilleneufcentquarantecinq"),
        ("Rue François Iᵉʳ", True, "francoispremier"),
        ("Rond-point Saint-Charles", True, "saintcharles"),
        ("Rue", True, "rue"),
        ("Voie X/13", True, "xtreize"),
        ("Bd St-Germain", True, "saintgermain"),
        ("12bis", False, "12bis"),
    ],
)
def test_core_names(name, strip, want):
    assert T.core_name(name, strip) == want


def test_numbers():
    assert [T.french_cardinal(n) for n in (0, 21, 71, 80, 81, 91, 200, 201, 1000, 1945)] == ["zero", "vingt-et-un", "soixante-onze", "quatre-vingts", "quatre-vingt-un", "quatre-vingt-onze", "deux-cents", "deux-cent-un", "mille", "mille-neuf-cent-quarante-cinq"]
    assert [T.french_ordinal(n) for n in (1, 4, 5, 9)] == ["premier", "quatrieme", "cinquieme", "neuvieme"]
    assert T.roman_value("XIV") == 14
    assert len({T.french_cardinal(n) for n in range(20_000)}) == 20_000


def test_cleaning(spark):
    assert T.expanded("R DES ECLUSES") == "Rue Des Ecluses".replace("Des", "des")
    assert T.expanded("AV D'ARTAGNAN") == "Avenue D'Artagnan"
    assert T.cleaned_export("_x008E_ a|b [sic] [italique : Paris]\x90") == "Ž a b Paris"
    assert T.unmangled("cafÃ©") == "café" and T.unmangled("Âge d'or") == "Âge d'or"
    assert one(spark, "BONJOUR. ICI PARIS", T.calm) == "Bonjour. Ici paris"
    assert one(spark, "BONJOUR. ICI PARIS", T.calm_strict) == "Bonjour. ici paris"
    assert one(spark, "Déjà mixte. ok", T.calm) == "Déjà mixte. ok"
    assert one(spark, "cons-\ntruit", T.dehyphenate) == "construit"
    assert one(spark, " a  b\r\n\n\n c ", T.squeeze) == "a b\n\n c"
    assert one(spark, "Rue de l'Élysée", T.key_alnum) == "ruedelelysee"
    assert one(spark, "Rue de l'Élysée", T.key_words) == "rue de l elysee"
    assert one(spark, None, T.key_core) is None
    assert one(spark, "abc", T.h32) == 96354
    assert one(spark, "| la rue SNCF 77 -", T.trim_edges) == "la rue SNCF"


def test_prose():
    text = "Histoire de Paris\nune rue\n||| ## |\nLe roi fit ouvrir cette rue ancienne\nelle mène à la place royale toujours\nXX 11 22"
    assert T.prose(text) == ["Le roi fit ouvrir cette rue ancienne", "elle mène à la place royale toujours"]
    assert T.prose("") == []


def test_edit_distance(spark):
    assert T.osa_distance("cartoux", "catroux") == 1 and T.osa_distance("ca", "abc") == 3
    names = ["".join(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    r = random.Random(4)
    names += ["".join(r.choice("abc") for _ in range(r.randint(3, 7))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.a, x.b) for x in fuzzy.close_pairs(df, df, "name").collect()}
    assert got == {(a, b) for a in set(names) for b in set(names) if T.osa_distance(a, b) <= 1}


def test_merge_rules(spark):
    rows = spark.createDataFrame([(1, "o" * 50, "v" * 120, None), (2, "o" * 50, "v" * 70, None), (3, None, None, "mots communs repris"), (4, None, None, None)], "id int, osm string, vlm string, ocr string")
    sources = [(c, F.col(c)) for c in ("osm", "vlm", "ocr")]
    src, body = resolve.chosen(sources)
    out = rows.withColumn("src", src).withColumn("body", body)
    out = out.withColumn("conf", resolve.confidence(F.col("src"), F.col("body"), sources, "ocr"))
    assert [(r.src, r.conf) for r in out.orderBy("id").collect()] == [("vlm", "high"), ("vlm", "high"), ("ocr", "low"), (None, "none")]
    values = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "v double")
    assert values.agg(resolve.upper_median(F.col("v")).alias("m")).first().m == 0.6


def test_street_ways(spark):
    rows = [("Rue Alpha", "residential", None), ("Rue Alpha", "cycleway", None), ("Rue Alfa", "cycleway", None), ("Quai Neuf", "cycleway", None), ("Piste", "cycleway", None), ("La Coulée Verte René-Dumont", "cycleway", None), ("Rue B", "steps", None), ("Voie A/1", "service", None), ("Rue C", "residential", "sidewalk"), ("Parking D", "service", None), (None, "service", None)]
    df = spark.createDataFrame(rows, "name string, highway string, footway string")
    # Alfa and Alpha are two edits apart
    assert sorted(r.name for r in filters.street_ways(df).collect()) == ["La Coulée Verte René-Dumont", "Quai Neuf", "Rue Alfa", "Rue Alpha"]


WEIRD = [
    None, "", "   ", "R DES ECLUSES", "av d'artagnan", "AV D'ARTAGNAN", "bd   SAINT-JEAN DE L'ÉTÉ", "  RPT 3BIS À LA PORTE ", "Inconnue DU nord", "MAIL", "Straße DES ß", "cité é",
    "_x008E_ a|b [sic] [italique : Paris]\x90", "_x0041_x0042_ _x009e__x00E9_", "[italique : a [b] c] [x] d]", "[ Italique:\tdeux\nlignes ] fin", "été [", "a  b\x85c", "_x00FF_x", "[]",
    "BONJOUR. ICI PARIS", "ÉTÉ!?… «OUI» ENCORE. 3 RUES\nNON", "...A. B.C", "\nLE ROI", "mixte. Ok", "ABC.d", "123. 456",
    "cafÃ©", "Âge d'or", "Ã©tÃ© â€™", "Ã et é", "ÃƒÂ©", "Â", "naÃ¯ve Â« x Â»", "日本Ã©",
]


def _calm(s, stops, lasting):
    """Sentence case by a walk over the characters."""
    letters = [c for c in s if c.isalpha()]
    if sum(c.isupper() for c in letters) <= 0.7 * len(letters):
        return s
    wish, out = True, ""
    for c in s.lower():
        out += c.upper() if wish and c.isalpha() else c
        wish = c in stops or (wish and lasting and not c.isalpha())
    return out


def test_columns_equal_single_values(spark):
    """The column forms against the forms for one value and a walk over characters, on awkward texts and real ones."""
    values = WEIRD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    values += [v.upper() for v in values if v]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    made = [T.expand_abbreviations(v), T.clean_export(v), T.calm(v), T.calm_strict(v), T.repair_mojibake(v)]
    plain = [T.expanded, T.cleaned_export, lambda s: _calm(s, ".!?…\n", True), lambda s: _calm(s, ".!?…", False), T.unmangled]
    for row in df.select(v, *[c.alias(f"c{i}") for i, c in enumerate(made)]).collect():
        for got, f in zip(row[1:], plain, strict=True):
            assert got == (None if row.v is None else f(row.v)), (row.v, got)


def test_repair_leaves_a_trace_alone():
    def step_by_step(s):
        for page in ("cp1252", "latin-1"):
            try:
                told = s.encode(page).decode()
            except UnicodeError:
                continue
            if any(m in s for m in ("Ã", "Â", "â€")) and "Ã" not in told and "Â" not in told:
                return told
        return s

    for s in [w for w in WEIRD if w] + ["Ã©?", "? Ã©�", "Ã\x81", "â€œx", "Ãª?日"]:
        assert T.unmangled(s) == step_by_step(s), s


def test_close_pairs_are_met_once(spark):
    """Each pair comes from one key: nothing is left out, repeated or tested, also between different sides, with nulls, swaps,
    repeated letters and signs beyond the basic plane; the join makes little more than the pairs."""
    r = random.Random(9)
    left = ["".join(r.choice("ab😀") for _ in range(r.randint(0, 5))) for _ in range(120)] + [None, "aab", "aba", "", "a"]
    right = ["".join(r.choice("ab😀") for _ in range(r.randint(0, 5))) for _ in range(120)] + [None, "abb", "aba", "b"]
    a, b = (spark.createDataFrame([(n,) for n in side], "name string") for side in (left, right))
    got = sorted((x.a, x.b) for x in fuzzy.close_pairs(a, b, "name").collect())
    assert got == sorted((x, y) for x in set(left) - {None} for y in set(right) - {None} if T.osa_distance(x, y) <= 1)
    # running numbers: all but one sign is shared by ten, and no key by more than ten names of a side
    numbers = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("name"))
    keyed = fuzzy._keyed(numbers, "name", "a", True)
    assert keyed.where("kind <> 0").groupBy("kind", "k").count().agg(F.max("count")).first()[0] <= 10


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString().lower()


def test_line_filter_by_value(spark):
    """No expression is interpreted per line, and lines are told by categories: ª is no lower-case letter, and a blank may be any."""
    from terralex.plans import text_queries

    assert "lambda" not in _plan(text_queries.line_filter(spark, "/root/testdata/sf0.001"))
    good = "une rue ancienne mène à la place"
    assert T.scored_lines(f"deux mots\nxx\n{good}\n\n## {good}") == [good, f"## {good}"]
    assert T.scored_lines("les deux\nmots ici\nles rues\nune place") == ["une place"]
    assert T.scored_lines("") == [] and T.scored_lines("ªªªªª une rue ancienne"[:12]) == [] and T.scored_lines(" \x85") == []


def test_export_by_value(spark):
    """No expression is interpreted per escape or note; blanks and line ends are Unicode's, case is ASCII's."""
    assert "lambda" not in _plan(spark.range(1).select(T.clean_export(F.lit("a"))))
    for s, want in (("[ Italique : a\x85b] c", "a c"), ("[ıtalique : a] b", "b"), ("_x00FF__x0041_a", "ÿ a"), ("a||__b", "a b")):
        assert T.cleaned_export(s) == want and one(spark, s, T.clean_export) == want


def test_panels_by_value(spark):
    """No expression is interpreted per sentence, and a ratio makes no array of letters."""
    from terralex.plans import text_queries

    plan = _plan(text_queries.cleaned_panels(spark, "/root/testdata/sf0.001").select("calm", "strict", "panel"))
    assert "lambda" not in plan and "regexp_count" not in plan and "regexp_extract_all" not in plan
    assert "regexp_count" not in _plan(text_queries.shout_ratio(spark, "/root/testdata/sf0.001"))
    assert one(spark, "ÇA VA. «ÉTÉ» ICI", T.calm) == "Ça va. «Été» ici" and one(spark, "«ÉTÉ».ICI", T.calm_strict) == "«été».Ici"


def _plain(text, lower):
    """Words by a walk over the characters."""
    out, word = [], ""
    for c in (text.lower() if lower else text) + " ":
        if "a" <= c <= "z" or "à" <= c <= "ÿ" or (not lower and ("A" <= c <= "Z" or "À" <= c <= "ÿ")):
            word += c
            continue
        if len(word) >= 3:
            out.append("".join(x for x in unicodedata.normalize("NFD", word) if ord(x) < 128).lower())
        word = ""
    return out


def test_plain_words_by_value(spark):
    """A word may lose all its letters, signs beside the letters end it, and only texts in lower case have Kelvin's K."""
    texts = [*(w for w in WEIRD if w is not None), "××× Straße ÷÷÷", "×××", "aKb Kilo Åab İİİa Ÿyy", "ÀÉÎ œuvre Øre 日本 ab", "été été\x00abc"]
    df = spark.createDataFrame([(None,), *((t,) for t in texts)], "v string")
    for v, some, low in df.select("v", T.plain_words(F.col("v")), T.plain_words(F.col("v"), lower=True)).collect():
        assert (some, low) == (([], []) if v is None else (_plain(v, False), _plain(v, True))), v
    assert "regexp_extract_all" not in _plan(df.select(T.plain_words(F.col("v"))))


def test_found_in(spark):
    """Common and other values, null ones, copies of members and groups without hits, for any bound of what is common."""
    from terralex.operators.skew import found_in, with_keys

    r = random.Random(18)
    rows = [(r.randint(0, 9), r.choice([None, "a", "a", "a", "b", *map(str, range(60))])) for _ in range(700)] + [(None, "a"), (10, "none"), (11, None)]
    members = [None, "a", "a", "1", "5", "7", "never", *map(str, range(30, 50))]
    want = {g: (sum(x == g for x, _ in rows), sum(x == g and v is not None and v in members for x, v in rows)) for g, _ in rows}
    df, of = spark.createDataFrame(rows, "g int, v string"), spark.createDataFrame([(m,) for m in members], "m string")
    for common in (1, 8, 1 << 18):
        got = found_in(df, "g", "v", of, common).collect()
        assert len(got) == len(want) and {x.g: (x.tokens, x.hits) for x in got} == want
    assert found_in(df.where("g > 99"), "g", "v", of).count() == 0
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,), (77,)], "g int")
    for held in (0, 100):
        assert sorted(x.g for x in with_keys(df, keys, "g", held).collect()) == sorted(g for g, _ in rows if g in (1, 3))


def test_known_words_stay_with_their_texts(spark, monkeypatch):
    """words and texts aren't shuffled or staged; what is shuffled are a task's distinct words and rows of rare ones."""
    from terralex.operators import skew
    from terralex.plans import text_queries

    staged = []
    for module in (skew, text_queries):
        monkeypatch.setattr(module, "stage", lambda df, name, f=module.stage: staged.append(f(df, name)) or staged[-1])
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("F18", "F18")
    try:
        rows = text_queries.known_words(spark, "/root/testdata/sf0.01").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = sum(x.tokens for x in rows)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    done = {s for j in sc.statusTracker().getJobIdsForGroup("F18") for s in sc.statusTracker().getJobInfo(j).stageIds}
    stages = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in done]
    assert sum(s.shuffleWriteRecords() for s in stages) < words
    assert all(t.count() < words / 4 for t in staged)
