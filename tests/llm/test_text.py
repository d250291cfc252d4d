"""Look-alikes, encodings, repeated lines and boilerplate on small inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from inkloom.llm import boilerplate as B
from inkloom.llm import encoding as E
from inkloom.llm import lookalikes as L
from inkloom.llm import repeated_lines as R

PLAIN = [
    ("Ｃｏｎｆ１", "Conf1"), ("conﬁg", "config"), ("a b c", "a b c"), ("re⁠ce­nt​", "recent"), ("Ка́бель", None), ("éá̧", "éá̧"),
    ("Кnown", "Known"), ("Oбзop", "Обзор"), ("fοlder", "folder"), ("USB-кабель m² № ™ ½ （3）", None), ("👩‍💻 ok", None), ("й", "й"), ("Не всё", None), ("Не", "He"), ("", None), (None, None), ("​", ""),
]


def test_plain_texts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(PLAIN)] + [(0, PLAIN[0][0], 1)], "id int, text string, plain int")
    got = {r.id: r.plain for r in L.plain_texts(df, "text", ["id"]).collect()}
    for i, (text, wanted) in enumerate(PLAIN):
        wanted = None if wanted is None else unicodedata.normalize("NFC", wanted)
        assert got.get(i) == (None if wanted == text else wanted), (text, got.get(i))
    assert L.plain_texts(df.limit(0), "text", ["id"]).count() == 0


def test_batches_without_suspects(spark):
    df = spark.createDataFrame([(i, "Обзор, café" if i % 3 else "cаfé") for i in range(12)], "id int, text string").coalesce(1)
    plain_only = df.where("id % 3 > 0")
    assert L.plain_texts(plain_only, "text", ["id"]).count() == 0
    assert L.changed_texts(L.suspects(plain_only, "text", ["id"]), ["id"]).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # batches with and without, in one task
    try:
        got = {r.id: r.plain for r in L.plain_texts(df, "text", ["id"]).collect()}
        changed = {r.id for r in L.changed_texts(L.suspects(df, "text", ["id"]), ["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {0: "café", 3: "café", 6: "café", 9: "café"}
    assert changed == set(got)


def test_long_mark_runs_and_long_words(spark):
    df = spark.createDataFrame([(1, "e" + "́" * 9 + "x" * 3000)], "id int, text string")
    assert L.plain_texts(df, "text", ["id"]).first().plain == unicodedata.normalize("NFC", "e" + "́" * 9) + "x" * 3000


CORPUS = [
    "Die Übersicht für größere Mengen prüft “Entwürfe” – später.", "L’accès à la règle d’été est protégé; où ça ?", "Настройка сервиса печати и журнала аудита – просто.", "The café doesn’t open “early” — see naïve résumé.",
    "Если параметр пуст, используется значение родительской папки.", "Каждый закрытый индекс получает метку «Новый» до публикации.", "取込キューを設定する、監査ログの権限。", "El año pasado la versión sustituía la auditoría.",
] * 6


@pytest.fixture(scope="module")
def model():
    return E.Classifier.train(CORPUS)


@pytest.mark.parametrize("chain", ["utf-8 > cp1252", "utf-8 > latin-1", "utf-8 > cp1251", "utf-8 > cp437", "utf-8 > mac-roman", "utf-8 > cp1252 > utf-8 > cp1252", "cp1251 > latin-1", "koi8-r > cp1251", "cp866 > cp1251"])
def test_round_trip_of_chains(model, chain):
    hits = 0
    for text in CORPUS[:8]:
        bad = E.garble(text, chain)
        if bad is None or bad == text:
            continue
        assert E.invert(bad, chain) == text
        back, chains = model.repair(bad)
        assert chains, (chain, bad)
        hits += back == text
    assert hits >= 1


def test_clean_and_quoted_text_stay(model):
    for text in CORPUS[:8] + ["", "plain", "Write `Ã©` or `â€™` here.", "```\nÃ©tÃ©\n```"]:
        assert model.repair(text) == (text, [])
    assert model.repair("a � b")[1] == [E.LOST]


def test_repair_frame(spark, model):
    df = spark.createDataFrame([(1, "Die Ãœbersicht fÃ¼r Mengen"), (2, None), (3, ""), (4, "ok")], "id int, text string")
    assert [tuple(r)[:2] for r in E.repair_text(df, "text", model, ["id"]).collect()] == [(1, "Die Übersicht für Mengen")]
    assert E.repair_text(df.limit(0), "text", model, ["id"]).count() == 0


def test_repeated_lines_match_brute_force(spark):
    rows = [(i, "s" if i % 3 else None, f"u{i // 2}", f"Share  THIS page {i}!\n# Share this page\n| share this page |\n[Share this](x{i}) page\nline {chr(97 + i % 5)}\n```\nShare this page\n```\n[1](/abc)\n") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "id long, site string, url string, t string").withColumn("site_host", F.lit(1))
    got = {(r.id, r.line_no) for r in R.repeated_lines(df, "t", "site", "url", "id", 12).collect()}
    docs = {}
    for i, s, u, t in rows:
        for n, line in ((1, "share"), (4, "share"), (5, t.split("\n")[4])):
            if s:
                docs.setdefault(line, set()).add(u)
    want = {(i, n) for i, s, u, t in rows if s for n, line in ((1, "share"), (4, "share"), (5, t.split("\n")[4])) if len(docs[line]) >= 12}
    assert got == want and want
    kept = R.without_lines(df.select("id", "t").distinct(), "t", "id", spark.createDataFrame([(0, 1), (0, 2)], "id int, line_no int")).where("id = 0").first().t
    assert kept == "\n".join(rows[0][3].split("\n")[2:])
    assert R.repeated_lines(df.limit(0), "t", "site", "url", "id").count() == 0


def test_wordings():
    text = "Share  THIS page ²5!\n # no\n[1](/abc)\n[Straße](x) ½\n\n ```\nin\n```\n|no|\n_a_b"
    assert R.wordings(text) == [(1, "share this page", "sharethispage"), (4, "strasse", "strasse"), (10, "a b", "ab")]
    assert R.wordings("") == []


def test_repeated_templates(spark, monkeypatch):
    """Bylines with different names are one template with slots, whether its leaf grows in one piece or in several."""
    names = "abcdefghijklmnopqrst"
    rows = [(i, "s", f"u{i}", f"Written by {names[i] * 4} at the desk\nOnly here {names[i] * 3}.\nLegal notice of us") for i in range(20)]
    df = spark.createDataFrame(rows + rows[:3], "id long, site string, url string, t string")
    get = lambda: sorted(tuple(r) for r in R.repeated_templates(df, "t", "site", "url", "id", 12).collect())
    legal, written, only = ("s", "legal notice of us", 1, 23, 20), ("s", "written by * at the desk", 20, 23, 20), ("s", "only here *", 20, 23, 20)
    assert get() == sorted([legal, written, only])
    found = {(r.id, r.line_no) for r in R.repeated_lines(df, "t", "site", "url", "id", 12).collect()}
    assert found == {(i, 3) for i in range(20)}  # the wording counts, within its template
    monkeypatch.setattr(R, "CROWD", 5)
    monkeypatch.setattr(R, "SMALL", 0)
    assert get() == sorted([legal, written, only])
    assert R.repeated_templates(df.limit(0), "t", "site", "url", "id").count() == 0


def test_spellings_of_one_wording(spark):
    """A wording counts over all its spellings, though they go to leaves of their own."""
    rows = [(i, "s", f"u{i}", "Accept all of it" if i % 2 else "Ac cept all of it") for i in range(24)]
    df = spark.createDataFrame(rows, "id long, site string, url string, t string")
    assert R.repeated_lines(df, "t", "site", "url", "id", 12).count() == 24


def test_leaf_growth():
    leaf = R.Leaf(3)
    assert [leaf.grow(x.split()) for x in ("a b c", "a b d", "x y z", "a b c", "p q r", "s t u", "v w x")] == [0, 0, 1, 0, 2, 3, 4]
    assert leaf.patterns()[:2] == ["a b *", "x y z"]


def test_wrapper_alignment():
    w = B.Wrapper()
    made = [w.align(stream, [False] * len(stream), doc, 1) for doc, stream in enumerate(([1, 2, 5], [1, 3, 5], [1, 2, 3, 4, 5], [3, 1, 5]))]
    order = lambda places: [w.rank[p] for p in places]
    assert all(order(places) == sorted(order(places)) for places in made)
    assert made[0][0] == made[1][0] == made[2][0] and w.docs[made[0][0]] == {0, 1, 2} and w.pages[made[0][2]] == 4
    assert made[3][0] != made[1][1] and w.docs[made[3][0]] == {3}  # out of order: a place of its own
    for n in range(200):  # ever narrower gaps between two places are numbered anew
        w.align([1, 1000 + n, 999 + n, 5] if n else [1, 1000, 5], [False] * (4 if n else 3), n)
    assert len({w.rank[w.places[1000 + n][0]] for n in range(200)}) == 200


def _streams(pages):
    key = {c: ord(c) << 4 for c in "ABCDST"}
    return [(n, [B.TITLE] + [B.TEXT] * len(p), [0] * (len(p) + 1), [0] + [key.get(c, 0) for c in p], [""] * (len(p) + 1), 1) for n, p in enumerate(pages)], set(key.values())


def test_alignment_decides(monkeypatch):
    """S stands on three pages at three places, T on three at one; both recur alike."""
    pages = ["ASxTBCD", "ATBSxCD", "AxTBCSD", "AxBCD"]
    streams, known = _streams(pages)
    text = lambda: ["".join(c for c, m in zip(p, marks[1:], strict=True) if not m) for p, marks in zip(pages, B.infer_and_parse(streams, known, set()), strict=True)]
    assert text() == ["Sx", "Sx", "xS", "x"]
    plain = lambda self, stream, follows, doc, weight=1: [self.places.setdefault(t, [len(self.places)])[0] for t in stream]
    monkeypatch.setattr(B.Wrapper, "align", plain)
    monkeypatch.setattr(B.Wrapper, "__init__", lambda self: self.__dict__.update(places={}, rank=[], docs=[{1, 2, 3}] * 99, pages=[9] * 99, text=[0] * 99))
    assert text() == ["x", "x", "x", "x"]  # without an order, recurrence alone would decide


def test_kinds_and_slots():
    reader = B._Reader()
    title, numbers, kinds, flags, keys, labels = reader.read("x\n# Ti 1\n\n```\n# no\n```\n- [a](#b)\n1. [a](b)\n[a](b) · [c](d)\nBy Acme Lee, today\nRead on:\n| a |", "acme")
    assert title == "ti" and numbers == [1, 2, 4, 7, 8, 9, 10, 11, 12]
    assert kinds == [B.TEXT, B.TITLE, B.CODE, B.TOC_ITEM, B.LINK_ITEM, B.LINKS, B.TEXT, B.TEXT, B.TABLE]
    assert labels[6] == "by {} lee today" and not labels[0] and flags[7] == B.OPENS and keys[1] == keys[3] == 0 != keys[6]
    by = lambda a, b: f"by {a} {b} today"
    labels = {by("ann", "lee"), by("bob", "ray"), by("cat", "doe")}
    known = {k for label in labels for k in B.label_keys(label)}
    assert len(set(B.slots(labels, known, set()).values())) == 1 and B.slots(labels, set(), set()) == {}


def test_boilerplate_lines(spark):
    def page(i):
        return f"Menu\n- [Home](/h)\n\n# Guide {chr(97 + i)}x\n\nBy Ann{chr(97 + i)} Lee{chr(97 + i)} today\n\nThe guide {i} says {chr(97 + i) * 4}. More.\n\n## Example\n\nAll about {chr(98 + i) * 3}.\n\nRead these {chr(97 + i) * 5} chapters in order:\n- [B](u{i})\n\n### See also\n- [C{i}](v)\n\n© 2020 Acme. All rights.\n"

    rows = [(i, "acme.test", f"u{i}", page(i), "Acme") for i in range(8)] + [(50, "tiny.test", "t", page(3).replace("Acme", "Tiny"), "Tiny"), (51, None, None, None, None), (52, "x.test", "x", "", None), (None, "x.test", "x", "a", None)]
    df = spark.createDataFrame(rows + rows[:2], "id long, site string, url string, t string, own string").withColumn("line_no", F.lit(0))
    found = B.boilerplate_lines(df, "t", "site", "url", "id", "own").collect()
    got = {}
    for r in found:
        got.setdefault(r.id, set()).add(r.line_no)
    assert len(found) == sum(map(len, got.values()))
    assert got[0] == got[7] == {1, 2, 6, 17, 18, 20} and got[50] == {1, 2, 18} and set(got) == {*range(8), 50}
    assert B.boilerplate_lines(df.limit(0), "t", "site", "url", "id", "own").count() == 0


@pytest.mark.parametrize(("part", "shared"), [(3, 500_000), (20_000, 0), (3, 0)])
def test_parts_and_joined_constants(spark, monkeypatch, part, shared):
    """Sites cut into parts, and constants of other hosts that are joined, give what one part and a broadcast give."""
    foot = "All rights are with us.\nWritten without consent of nobody.\n"
    rows = [(s * 100 + i, f"s{s}", f"u{i}", f"# T{chr(97 + i)}{chr(97 + s)}\n\nText {chr(97 + i) * 3}{chr(97 + s)} here.\n\n{foot}", None) for s in range(4) for i in range(9 if s < 3 else 1)]
    df = spark.createDataFrame(rows, "id long, site string, url string, t string, own string")
    run = lambda: sorted(tuple(r) for r in B.boilerplate_lines(df, "t", "site", "url", "id", "own").collect())
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "SHARED", shared)
    assert run() == sorted((r[0], n) for r in rows for n in (5, 6))


def test_long_notices_are_boilerplate(spark):
    notice = "We use cookies, and this licence notice says at length which ones. " * 12
    rows = [(i, "acme.test", f"u{i}", f"# Guide {chr(97 + i)}x\n\nAll about {chr(97 + i) * 4} is said here. {chr(97 + i) * 400}.\n\n{notice}{i}\n", None) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, site string, url string, t string, own string")
    assert sorted(tuple(r) for r in B.boilerplate_lines(df, "t", "site", "url", "id", "own").collect()) == [(i, 5) for i in range(4)]


def test_deep_chains_come_out(model):
    """More steps than any listed chain has."""
    text, chain = "L’accès à la règle d’été est protégé; où ça ?", "utf-8 > cp1252 > utf-8 > cp1252"
    bad = E.garble(E.garble(text, chain), chain)
    assert model.repair(bad)[0] == text and model.repair(bad)[1]


def test_encoding_classifier_on_held_out_words(model):
    """Words that the model hasn't seen, garbled by the chains of UTF-8; nothing but the classifier decides."""
    clean = "Größenänderung läßt früher Überblicke für schöne Häuser zu; später prüfen wir Münzen."
    chains = [c for c in E.CHAINS if c.startswith("utf-8 > ") and c.count(">") == 1 and "koi8" not in c and "866" not in c and "1251" not in c]
    got = [model.repair(E.garble(clean, c)) for c in chains]
    assert sum(back == clean for back, _ in got) >= len(chains) - 1 and all(found for _, found in got)
    assert model.repair(clean) == (clean, [])


def test_gate_knows_what_the_tables_know():
    """Every character that is written otherwise by itself passes the gate, in a word of its own and inside one."""
    for ch, out in L.parts().items():
        if unicodedata.normalize("NFC", out) != ch and ch not in "‍" and not "︀" <= ch <= "️":
            assert L.odd_words(f"a {ch}b c")[1] == [f"{ch}b"], hex(ord(ch))
    assert L.odd_words("plain é Привет 日本語 ™ №") == (False, [])


def test_marks_of_many_scripts(spark):
    """Order of Arabic, Hebrew and Indic marks, Hangul letters, presentation forms, and a word with very many marks."""
    many = "e" + "\u0323\u0301" * 1500
    cases = ["\u05d0\u0591\u05b8", "\u0628\u0651\u064e", "\u0915\u093c", "\u1112\u1161\u11ab", "\uffbe\uffc2\uffa4", "\ufefb", "\U0002f800", many, "\u0958"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {r.id: r.plain for r in L.plain_texts(df, "text", ["id"]).collect()}
    assert got[0] == unicodedata.normalize("NFC", cases[0]) != cases[0] and got[1] == unicodedata.normalize("NFC", cases[1]) != cases[1]
    assert 2 not in got and got[3] == "\ud55c" and got[4] == unicodedata.normalize("NFKC", cases[4]) and got[5] == "\u0644\u0627" and got[6] == "\u4e3d"
    assert got[7] == unicodedata.normalize("NFC", many) and got[8] == "\u0915\u093c"


def test_double_byte_lines_come_out_whole(model):
    """Second bytes that look like brackets or bars cut words apart; the line as a whole comes out."""
    text = "取込キューを設定する、監査ログの権限。"
    for chain in ("shift-jis > latin-1", "euc-jp > latin-1", "euc-jp > cp1252"):
        assert model.repair(E.garble(text, chain))[0] == text
