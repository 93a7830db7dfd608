import random

from sitelens.llm import mojibake as m

CLEAN = [
    "Größe und Füße für süße Mädchen", "Élégante étagère à découvrir bientôt", "Świeży plecak do małych wnętrz, żarówka", "Серия: тихий чайник и матрас на каждый день", "長持ちする本棚、防水の水筒を製作。", "El tazón español más económico",
    "Tea – from €5, “best” café at 40°C", "COLEÇÃO de verão", "Weisse Strasse, süsse Äpfel", "plain ascii",
]


def rows(seed=5):
    r = random.Random(seed)
    out = [(f"c{i}", CLEAN[i % len(CLEAN)], None, "w") for i in range(200)]
    bad = {}
    one = [("utf_8", x) for x in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251")]
    chains = [(x,) for x in one] + [(("utf_8", "cp1252"), ("utf_8", "cp1252")), (("koi8_r", "cp1251"),), (("cp1251", "koi8_r"),), (("iso8859_2", "cp1252"),), (("cp932", "latin_1"),), (("cp1252", "utf_8"),)]
    for i, ch in enumerate(chains):
        for j, t in enumerate(CLEAN):
            g = m.garble(t, ch)
            if g and g != t and not g.isascii():
                written = ch[0][0]
                if written == "utf_8" or (written in ("koi8_r", "cp1251") and j == 3) or (written == "iso8859_2" and j == 2) or (written == "cp932" and j == 4) or (ch[0][1] == "utf_8" and j in (0, 1)):
                    bad[f"b{i}-{j}"] = (g, t, ch)
                    out.append((f"b{i}-{j}", None, g, "w"))
    r.shuffle(out)
    return out, bad


def test_garbled_fields_are_found_and_restored(spark):
    data, bad = rows()
    df = spark.createDataFrame([*data, data[0], ("n", None, None, "w"), (None, "Ã¼ber", None, "w"), ("long", "Größe " * 4000, None, "w")], "id string, title string, meta_description string, word string")
    got = {(r["page_id"], r["field"]) for r in m.garbled_fields(df).collect()}
    want = {(i, "meta_description") for i in bad}
    assert got == want
    fixed = {r["page_id"]: r["original"] for r in m.restored_fields(df).collect()}
    assert set(fixed) == set(bad)
    for i, (g, t, ch) in bad.items():
        if ch[0][1] == "utf_8":
            assert fixed[i] is None  # replacement characters: lost
        else:
            assert fixed[i] in (t, None), (i, g)
    whole = [i for i, (g, t, ch) in bad.items() if ch[0][1] != "utf_8"]
    assert sum(fixed[i] == bad[i][1] for i in whole) >= 0.9 * len(whole)


def test_a_stretch_is_enough(spark):
    data = [(f"c{i}", t, None) for i in range(5) for t in CLEAN] + [("s", "Weiße Küchenmöbel und gemÃ¼tliche Glühlampen", None)]
    df = spark.createDataFrame([(f"{a}{i}", b, c) for i, (a, b, c) in enumerate(data)], "id string, title string, meta_description string")
    got = m.restored_fields(df).collect()
    assert [r["original"] for r in got] == ["Weiße Küchenmöbel und gemütliche Glühlampen"]
    assert m.garbled_fields(df.limit(0)).count() == 0


def test_tidied_white_space(spark):
    data = [(f"c{i}", t, None) for i in range(5) for t in CLEAN] + [("s", "CrÃ©maillÃ¨res discrÃ¨te, Ã  moitiÃ© prix", "prÃªte Ã poser")]
    df = spark.createDataFrame([(f"{a}{i}", b, c) for i, (a, b, c) in enumerate(data)], "id string, title string, meta_description string")
    got = {r["field"]: r["original"] for r in m.restored_fields(df).collect()}
    assert got == {"title": "Crémaillères discrète, à moitié prix", "meta_description": "prête à poser"}


def test_chains_round_trip():
    for ch in m.CHAINS:
        g = m.garble("Grüße", ch)
        if g and "�" not in g and g != "Grüße" and ch[-1][1] in m.SINGLE:
            assert m._read_back(g, ch) == "Grüße"


def test_copies_do_not_turn_the_direction(spark):
    chains = [(("koi8_r", "cp1251"), 3), (("iso8859_2", "cp1252"), 2), (("utf_8", "gbk"), 3)]
    for chain, k in chains:
        g = m.garble(CLEAN[k], (chain,))
        for numbered in (False, True):  # copies, or 400 texts that differ in a number only
            data = [(f"c{i}", f"{CLEAN[i % len(CLEAN)]} {i // len(CLEAN)}", None) for i in range(100 * len(CLEAN))]
            data += [(f"b{i}", None, f"{g} {i}" if numbered else g) for i in range(400)]
            df = spark.createDataFrame(data, "id string, title string, meta_description string").coalesce(4)
            got = {r["page_id"] for r in m.garbled_fields(df).collect()}
            assert got == {f"b{i}" for i in range(400)}, (chain, numbered, len(got), sorted(got)[:3])
