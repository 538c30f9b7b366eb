import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lonja.llm")

from lonja.llm.canonical import Affixes, Dictionary, Entry, deletes, fold, learn_affixes, map_to_reference, weighted_distance  # noqa: E402
from lonja.llm.leakage import ItemIndex, leaked_items  # noqa: E402
from lonja.llm.mixture import TOKENIZER, allot, count_tokens, mix_sources  # noqa: E402
from lonja.llm.mojibake import Restorer, corpus_model, restore_texts  # noqa: E402
from lonja.llm.stuffing import block_measures, sentence_ends, skeleton, stuffed_documents  # noqa: E402
from lonja.llm.words import words  # noqa: E402

NAMES = ["Bogotá", "Medellín", "Itagüí", "Ibagué", "Quibdó", "Cúcuta", "Aplicación móvil", "Catálogo impreso", "Nariño", "San Andrés", "Cali"]


@pytest.fixture(scope="module")
def model(spark):
    return corpus_model(spark.createDataFrame([(n,) for n in NAMES * 3], "v string"), "v", NAMES)


def test_round_trips_of_wrong_decoding(model):
    fix, bad = Restorer(model), []
    for n in NAMES:
        for text in (n, n.upper(), f"por {n} (2)", f"  {n} ", n.title()):
            for written, read in [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp850"), ("cp1252", "mac_roman")]:
                try:
                    damaged = text.encode(written).decode(read)
                    twice = damaged.encode("utf-8").decode("latin-1")
                except UnicodeError:
                    continue
                for d in {damaged, twice} if written == "utf-8" else {damaged}:
                    if d != text and fix.restore(d) != text:
                        bad.append((text, d, fix.restore(d)))
    assert not bad


def test_clean_text_is_left_alone(model):
    fix = Restorer(model)
    for clean in ["Bogotáá", "Nogotá", "EXPORTAÇÃO", "Göteborg", "Kraków", "Itagüí", "São Paulo", "tIENDA FÍÍSICA", "", "a", "ñ", "¿?", "東京", "Medellín" * 300]:
        assert fix.restore(clean) is None, clean
    assert fix.restore("Bogot�") == ""


def test_mutual_information_decides(model):
    damaged = ["BogotÃ¡", "Medell¡n", "Ibaguâ€™", "IbaguÚ", "Quibd¾", "NariÃ±o"]
    every = {d[i : i + 2] for d in damaged for i in range(len(d) - 1)} | set(model.scores)
    values = [model.scores.get(p, model.unseen) for p in sorted(every)]
    random.Random(1).shuffle(values)
    mixed = Restorer(model._replace(scores=dict(zip(sorted(every), values))))
    assert [mixed.restore(d) for d in damaged] != [Restorer(model).restore(d) for d in damaged]
    flat = model._replace(scores=dict.fromkeys(model.scores, model.unseen))
    assert all(Restorer(flat).restore(d) is None for d in damaged[3:5])
    assert model.scores["ot"] > 0 > model.unseen and "Ã¡" not in model.scores


def test_damage_that_is_common_stays_improbable(spark):
    rows = ["BogotÃ¡"] * 40 + ["Bogotá"] * 60 + ["Göteborg", "GÖTEBORG", "Bogoát"] * 5
    m = corpus_model(spark.createDataFrame([(r,) for r in rows], "v string"), "v", NAMES)
    fix = Restorer(m)
    assert [fix.restore(v) for v in ("BogotÃ¡", "Bogotß", "Göteborg", "GÖTEBORG", "Bogoát", "\xa0Bogotá")] == ["Bogotá", "Bogotá", None, None, None, None]


def test_restore_frame(spark, model):
    df = spark.createDataFrame([(1, "BogotÃ¡", None, "x"), (1, "BogotÃ¡", "", "x"), (2, "Cali", "Chía�", "x")], "id long, a string, b string, valor string")
    got = sorted(map(tuple, restore_texts(df, "id", ["a", "b"], model).select("id", "campo", "original").collect()))
    assert got == [(1, "a", "Bogotá"), (1, "a", "Bogotá"), (2, "b", "")]
    assert restore_texts(df.limit(0), "id", ["a"], model).count() == 0


def osa(a, b):
    m = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                m[i][j] = min(m[i][j], m[i - 2][j - 2] + 1)
    return m[-1][-1]


def test_symmetric_deletes_meet_every_near_name():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.insert(k, "x"), lambda: b.pop(k), lambda: b.__setitem__(k, "y")])()
        b = "".join(b)
        if osa(a, b) <= 2 and min(len(a), len(b)) > 2:
            assert set().union(*(deletes(a, k) for k in range(3))) & set().union(*(deletes(b, k) for k in range(3)))
            assert weighted_distance(b, a) <= osa(a, b)


def test_mapping(spark, model):
    ref = spark.createDataFrame([(1, "Bogotá", "BGX", ["Santafé de Bogotá"], "Cundinamarca"), (2, "Cali", "KLI", [], "Valle del Cauca"), (3, "Medellín", "MDN", None, "Antioquia"), (4, "Quibdó", "QBD", [], "Chocó")], "ref_id long, nombre string, codigo string, otros_nombres array<string>, departamento string")
    cases = {"Bogotá": None, None: None, "bogota": 1, "BogotÃ¡": 1, "Bogot�": 1, "bgx": 1, "SANTAFE DE BOGOTA": 1, "Cali/Valle del Cauca": 2, "Ciudad de Cali": 2, "xali": 2, "Meedllní": 3, "Medeyín (Antioquia)": 3, "Quito (EC)": 0, "Ciudad de Panamá": 0, "": 0, "?": 0, "N/D": 0, "z" * 50_000: 0}
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(cases)], "id long, lugar string, ref_id string")
    for limit in (10**6, 1):  # one dictionary, and a block for each entry
        got = {r["valor"]: r["ref_id"] for r in map_to_reference(df, "id", "lugar", ref, ["departamento"], model, max_keys=limit, before=("ciudad de",)).collect()}
        assert got == {k: v for k, v in cases.items() if v is not None}
    assert {r["ref_id"] for r in map_to_reference(df, "id", "lugar", ref.limit(0), ["departamento"], model).collect()} == {0}
    assert fold("Línea_Telefónica.") == "linea telefonica" and Dictionary([]).lookup("x") is None


def test_blocks_answer_like_one_dictionary(spark, model):
    ref = [Entry(1, ["Palmita"], None, ["Valle"], 0), Entry(2, ["Palmira"], "PLM", ["Valle"], 3), Entry(3, ["Rionegro"], "RNG", ["Antioquia"], 1), Entry(4, ["Rionegro"], None, ["Santander"], 9)]
    wide = Affixes(frozenset({"ciudad de"}), frozenset({"centro"}))
    one, each = Dictionary(ref, wide), [Dictionary([e], wide) for e in ref]
    cases = {"Ciudad de Palmira": 2, "Palmirra/Valle": 2, "Rionegro (Antioquia)": 3, "rio negro santander": 4, "Rionegro": 4, "plm": 2, "Ciudad de Rinegro Centro": 4, "Palmirra/Antioquia": None, "Pal?ira": 2}
    for text, want in cases.items():
        got = one.lookup(text)
        assert (got and got[3]) == want, text
        assert got == min((r for d in each if (r := d.lookup(text))), default=None), text
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abclosy") for _ in range(rng.randint(3, 11)))
    names = sorted({word() for _ in range(60)})
    entries = [Entry(k, [n], None, [], rng.randint(0, 3)) for k, n in enumerate(names)]
    one, parts = Dictionary(entries), [Dictionary(entries[k : k + 7]) for k in range(0, len(entries), 7)]
    for _ in range(600):
        q = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(q))
            rng.choice([lambda: q.insert(k, "x"), lambda: q.pop(k) if len(q) > 1 else None, lambda: q.__setitem__(k, "?")])()
        assert one.lookup("".join(q)) == min((r for d in parts if (r := d.lookup("".join(q)))), default=None)


def test_additions_are_learnt(spark, model):
    ref = spark.createDataFrame([(k, n, None, [], "Norte") for k, n in enumerate(["Cali", "Tunja", "Pasto", "Yopal"], 1)], "ref_id long, nombre string, codigo string, otros_nombres array<string>, departamento string")
    values = [(f"{n} - Propio", 2) for n in ("Cali", "tunja", "PASTO")] + [(f"Mpio. {n}", 2) for n in ("Cali", "Tunja", "Yopal")] + [("Nuevo Cali", 90), ("Cali (Norte)", 5), ("Tunja, Norte", 5), ("Pasto/Norte", 5), ("Yopal", 50)]
    df = spark.createDataFrame(values, "valor string, n long")
    assert learn_affixes(df, ref, ["departamento"], model) == Affixes(frozenset({"mpio"}), frozenset({"propio"}))
    typed = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(values)] + [(99, "Yopall propio")], "id long, lugar string")
    got = {r["valor"]: r["ref_id"] for r in map_to_reference(typed, "id", "lugar", ref, ["departamento"], model).collect()}
    assert got["Yopall propio"] == 4 and got["Mpio. Tunja"] == 2 and got["Pasto/Norte"] == 3 and got["Nuevo Cali"] == 0 and "Yopal" not in got
    assert learn_affixes(df.limit(0), ref, [], model) == Affixes()


def test_words():
    assert words("Straße 5 µm – la  ventila-\nción, «ÁÉ»") == [b"strasse", b"5", b"um", b"la", b"ventilacion", b"ae"]
    assert words("漢字 abc") == ["漢字".encode(), b"abc"] and words(None) == []


def brute(item, doc, least=25, edits=2):
    """Longest stretch by trying every start with every kind of edit."""
    best = 0

    def go(i, j, e, i0):
        nonlocal best
        while i < len(item) and j < len(doc) and item[i] == doc[j]:
            i, j = i + 1, j + 1
            best = max(best, i - i0)
        if e and i < len(item) and j < len(doc):
            go(i + 1, j + 1, e - 1, i0), go(i + 1, j, e - 1, i0), go(i, j + 1, e - 1, i0)

    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] == doc[j]:
                go(i, j, edits, i)
    return best >= least


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 70)))) for k in range(20)]
    docs = []
    for d in range(80):
        filler = lambda n: [rng.choice(vocab) for _ in range(n)]
        w = items[rng.randrange(20)][1].split()
        n = rng.choice([15, 22, 24, 25, 26, 30])
        start = rng.randrange(max(1, len(w) - n))
        part = w[start : start + n]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(part) - 1)
            rng.choice([lambda: part.insert(k, "neu"), lambda: part.pop(k), lambda: part.__setitem__(k, "alt")])()
        docs.append((d, ", ".join(filler(rng.randint(0, 80)) + part + filler(rng.randint(0, 80))).upper()))
    want = {(d, i) for d, t in docs for i, s in items if brute(words(s), words(t))}
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "x " * 60_000)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([*items, (99, None), (98, "corto")], "item_id long, text string")
    for room in (10**6, 300):  # one pass, and several
        got = {(r["doc_id"], r["item_id"]) for r in leaked_items(df, "doc_id", "text", it, "item_id", "text", max_index_words=room).collect()}
        assert got == want and len(want) > 20
    assert leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    asked = it.withColumn("q", F.when(F.col("item_id") == 3, F.lit("Qué pieza, dime, está al lado")))
    three = spark.createDataFrame([(1, items[3][1] + ". ¿Que pieza DIME esta al lado?"), (2, items[3][1] + " dime"), (3, items[4][1])], "doc_id long, text string")
    shares = {(r["doc_id"], r["item_id"]): r["pregunta"] for r in leaked_items(three, "doc_id", "text", asked, "item_id", "text", question="q").collect()}
    assert shares[1, 3] == 1.0 and shares[2, 3] == 0.0 and shares[3, 4] is None
    empty = ItemIndex([])
    assert empty.candidates([empty.coded("a b c")]) == []


def test_index_grows_with_the_items_only(monkeypatch):
    import pickle

    from lonja.llm import leakage

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    texts = [(k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(1600)]
    sizes = [len(pickle.dumps(ItemIndex([(*t, None) for t in texts[: 200 * m]]))) for m in (1, 2, 4, 8)]
    assert all(b < 2.3 * a for a, b in zip(sizes, sizes[1:]))
    # Groups of one block and of many retrieve the same.
    one = ItemIndex([(*t, None) for t in texts])
    docs = [" ".join(rng.choice(vocab) for _ in range(40)) + " " + " ".join(t.split()[5:40]) for _, t in texts[::50]]
    want = sorted((d, p, one.ids[i]) for d, p, i in one.candidates([one.coded(t) for t in docs]))
    monkeypatch.setattr(leakage, "GROUPS", 7)
    many = ItemIndex([(*t, None) for t in texts])
    assert many.per_group == 15 and len(want) >= len(docs)
    assert sorted((d, p, many.ids[i]) for d, p, i in many.candidates([many.coded(t) for t in docs])) == want


def test_allotment():
    a = [{"path": ("d", "es", "x"), "weight": 0.5, "capacity": 10}, {"path": ("d", "es", "y"), "weight": 0.2, "capacity": 100}, {"path": ("d", "en", "z"), "weight": 0.3, "capacity": 100}]
    got = allot(a, 100)
    # x lacks 40: its sibling y takes them before z does.
    assert got == pytest.approx({("d", "es", "x"): 10, ("d", "es", "y"): 60, ("d", "en", "z"): 30})
    assert sum(allot(a, 1000).values()) == pytest.approx(210)
    assert allot(a) == pytest.approx({("d", "es", "x"): 10, ("d", "es", "y"): 4, ("d", "en", "z"): 6})
    assert allot([]) == {}


def test_mixture(spark):
    rows = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(3000)] + [(9000, None, 5), (9001, "c", 5), (9002, "a", None), (9003, "a", 0)]
    df = spark.createDataFrame(rows, "id long, source string, tokens long").withColumn("peso", F.lit(1))
    goal = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("vacia", 0.0, 2)], "source string, peso double, max_repeticiones int")
    sel, report = mix_sources(df, "id", "tokens", ["source"], goal, seed=1)
    r = {x["source"]: x for x in report.collect()}
    assert r["a"]["parte"] == pytest.approx(0.4, abs=0.002) and r["b"]["parte"] == pytest.approx(0.6, abs=0.002) and r["vacia"]["tokens"] == 0
    got = sel.collect()
    assert len({x["id"] for x in got}) == len(got) and max(x["copias"] for x in got if x["source"] == "b") <= 3 and {x["copias"] for x in got if x["source"] == "a"} == {1}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(df.repartition(7), "id", "tokens", ["source"], goal, seed=1)[0].collect()))
    assert mix_sources(df.limit(0), "id", "tokens", ["source"], goal)[0].count() == 0


def test_the_cut_is_the_same_however_it_is_searched(spark, monkeypatch):
    from lonja.llm import mixture

    df = spark.createDataFrame([(i, "a" if i % 5 else "b", 1 + i * 7 % 90) for i in range(4000)], "id long, source string, tokens long")
    goal = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], "source string, peso double, max_repeticiones int")
    want = sorted(map(tuple, mix_sources(df, "id", "tokens", ["source"], goal, seed=3, budget=100_000)[0].collect()))
    monkeypatch.setattr(mixture, "CUT_ROWS", 5)
    monkeypatch.setattr(mixture, "PARTS", 8)
    got, report = mix_sources(df, "id", "tokens", ["source"], goal, seed=3, budget=100_000)
    assert sorted(map(tuple, got.collect())) == want
    assert {r["source"]: r["tokens"] for r in report.collect()} == pytest.approx({"a": 70_000, "b": 30_000}, abs=60)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "es", "x", 10) for i in range(10)] + [(100 + i, "es", "y", 10) for i in range(100)] + [(1000 + i, "en", "z", 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, idioma string, source string, tokens long")
    goal = spark.createDataFrame([("x", 0.5, 1), ("y", 0.2, 1), ("z", 0.3, 1)], "source string, peso double, max_repeticiones int")
    report = mix_sources(df, "id", "tokens", ["idioma", "source"], goal, seed=1, budget=1000)[1]
    assert {r["source"]: r["tokens"] for r in report.collect()} == {"x": 100, "y": 600, "z": 300}


def test_tokens(spark):
    import base64
    import os

    import tiktoken

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    from lonja.llm.mixture import PATTERN

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Die Düse 47, it's 3 µm\n\n  — ventilación", "", "x" * 5000, "a  b\t\tc <|endoftext|>", "漢字"]
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    assert [r["n"] for r in count_tokens(df, "t", "n").collect()] == [*(len(enc.encode_ordinary(t)) for t in texts), 0]


NOUNS = "valve sensor tube hinge cover plate lens screw pump rotor spring cable housing bracket nozzle gasket".split()


def prose(rng, n):
    """Sentences of varied form and length."""
    one, num = lambda: rng.choice(NOUNS), lambda: rng.randint(1, 99)
    how = ["directly", "by means of a thread", "without any further tool", "after cooling", "in most embodiments", "although this is not required"]
    forms = [
        lambda: f"The {one()} {num()} is fixed to the {one()} {num()} so that it rests on the {one()} {rng.choice(how)}.",
        lambda: f"In one embodiment, when the {one()} reaches {num()} degrees, the {one()} opens {rng.choice(how)}, and the {one()} stays where it was.",
        lambda: f"A further object of the invention, as FIG. {num()} shows, is a {one()} whose {one()} can be replaced {rng.choice(how)}.",
        lambda: f"Known devices (see {num()}) place the {one()} behind the {one()}; this makes it hard to reach the {one()}, which wears {rng.choice(how)}.",
        lambda: f"Preferably between {num()} and {num()} percent of the {one()} consists of steel, while the remaining part of the {one()} may be of any other material.",
    ]
    return " ".join(rng.choice(forms)() for _ in range(n))


def matter(rng, kind, n):
    one = lambda: rng.choice(NOUNS)
    line = {
        "links": lambda: f"http://{one()}{rng.randint(1, 999)}.test/{one()}/{rng.randint(1, 9999)}",
        "markdown": lambda: f"[{one()} {one()}](mor-{one()}{rng.randint(1, 99)}.example/{one()})",
        "tags": lambda: f"#{one()}{rng.choice(['', '2024', 'Best'])}",
        "catalogue": lambda: f"{one().title()} {one()} REF-{rng.randint(100, 9999)} {rng.randint(1, 999)},{rng.randint(10, 99)}",
        "keywords": lambda: rng.choice(["Top 7 cheap valve best valve.", "buy valve online, cheap valve?", "valve valve price best valve!"]),
    }[kind]
    return "\n".join(line() for _ in range(n))


def test_stuffing(spark):
    rng = random.Random(1)
    docs = [(k, prose(rng, rng.randint(15, 40)), "en") for k in range(150)]
    docs += [(1000, matter(rng, "links", 60), "en"), (1001, matter(rng, "tags", 250), "EN"), (1002, matter(rng, "keywords", 120), None), (1003, matter(rng, "catalogue", 90), "en"), (1004, matter(rng, "markdown", 80), "en"), (1005, prose(rng, 6) + "\n" + matter(rng, "tags", 300), "en")]
    docs += [(2000, prose(rng, 30) + "\n" + matter(rng, "links", 8), "en"), (2001, prose(rng, 20) + "\nKeywords: " + ", ".join(NOUNS), "en-x"), (2002, "", "en"), (2003, None, "en"), (2004, "   ", None), (2005, prose(rng, 3000), "en")]
    # Without end marks, but not redundant.
    docs += [(2006, prose(rng, 200).replace(".", ","), "en")]
    df = spark.createDataFrame(docs, "id long, text string, lang string").withColumn("parte", F.lit("clash"))
    assert {r["id"] for r in stuffed_documents(df, "id", "text", "lang").collect()} == {1000, 1001, 1002, 1003, 1004, 1005}
    assert sorted(r["id"] for r in stuffed_documents(df.union(df.filter("id = 1000")), "id", "text", "lang").collect()).count(1000) == 2
    assert stuffed_documents(df.limit(0), "id", "text", "lang").count() == 0


def test_stuffing_is_decided_by_compression(spark, monkeypatch):
    from lonja.llm import stuffing

    rng = random.Random(2)
    df = spark.createDataFrame([(k, prose(rng, 25), "en") for k in range(100)] + [(1000, matter(rng, "tags", 250), "en")], "id long, text string, lang string")
    assert [r["id"] for r in stuffed_documents(df, "id", "text", "lang").collect()] == [1000]
    expected = stuffing.expectations(stuffing.measured_documents(df, "id", "text", "lang"))
    block = {"chars": 600, "ends": 0, "ratio": expected[()][1], "skeleton": expected[()][3]}
    assert not stuffing.is_matter(block, "en", expected) and stuffing.is_matter(block | {"ratio": 0.05}, "en", expected)
    assert not stuffing.is_matter(block | {"ratio": 0.05, "ends": 3}, "en", expected)


def test_blocks_make_up_the_text():
    rng = random.Random(4)
    for text in (prose(rng, 50), "x", "a. b", prose(rng, 3) + "\n" + "z" * 5000, "漢字。" * 700):
        got = block_measures(text)
        assert sum(b["chars"] for b in got) == len(text) and max(b["chars"] for b in got) <= 900
        assert sum(b["ends"] for b in got) == len(sentence_ends(text))
    assert skeleton("Ab1, c22\né".encode()) == b"a9, a9\na"
