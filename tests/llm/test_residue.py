import random
import unicodedata

import pytest

from axonlake.llm import residue as module
from axonlake.llm.residue import ALIKE, cluster, cue, meaningless, residue, slots, text_lines, units

NORMAL = [f"The {a} arm keeps {n} weak rows of the inner ring after the swap control." for a in ("left", "right", "wired", "free") for n in range(5)]
OPEN = [
    "Hello {{name}}, all is well.", "Seed <%= seed %> was rerun.", "Author: [REVIEWER NAME]", "# %PHASE% report", "The ${cellType} column", "Cell: XXXX", "We met @reviewer_name@ there.", "Region: ........",
    "The [insert cell type] cells", "In {0} the {1} cells", "Die (Zelltyp hier eintragen)-Zellen", "The __TOP_K__ inputs", "It took %(n)s steps", "Run «run date» ended", "PHASE_HERE asked", "From <cell type> to Ring19",
    "The [cell count] rows", "Region: {*top k*}", "A {~cell_type~} cell", "Cell: ~~root_id~~", "It passed %7$s today",
]
CLOSED = [
    "The template writes `{{name}}` here.", 'Our checker looks for "[[run date]]" and found none.', "Unfilled slots such as [CELL TYPE] or ____ were replaced by hand.", "Compare with {1, 2, 4} hops.", "About 47% of 5 cells", "See [12] and [Smith 2020].",
    "W_{ij} is the weight", "It is <0.05 below and >0.1 above", "<b>bold</b> text", "Kv31' and Tq58' links", "The rule is $x_{i}$ here.", "-----", "Wait... what", "mail a@b.example now",
]


def test_slots():
    assert [t for t in OPEN if not slots(t)] == []
    assert [t for t in CLOSED if slots(t)] == []


def test_lines():
    text = 'Prose here.\n```\nHello {{name}}\n```\n    x = {{y}}\na,b,c,d\n{"seq": 1, "say": "{{x}}"}\n{"error": {"code": 500}}\n<noscript>Allow scripts.</noscript>\n\n'
    assert [k for k, line in text_lines(text) if line.strip("`")] == ["prose", "code", "code", "table", "log", "page", "page"]


def test_units_and_verdicts():
    assert units("- Cell 12 keeps AL_R. It said 'no way' twice!") == ["cell * keeps *", "it said * twice"]
    assert cue(units("404 Not Found")[0]) == "error" and cue("please enable javascript to view the scene") == "notice" and cue("content goes here") == "filler" and cue("the arm keeps its rows") is None
    assert meaningless("asdf qwer jkl asdf fgh".split(), 0) and meaningless(["bla"] * 20, 20) and not meaningless("one two three four".split(), 4)


def test_cluster():
    got = dict(cluster([("a b c d e", 3), ("a b c d f", 1), ("x y z v w", 1)]))
    assert got["a b c d e"] == got["a b c d f"] and got["x y z v w"] != got["a b c d e"]


def test_cluster_equals_plain_search():
    """Looking templates up by stretch finds what comparing with all of them finds."""
    rng = random.Random(4)
    texts = sorted({" ".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    found, want = [], {}
    for text in texts:
        words = text.split()
        same = [sum(a == b for a, b in zip(words, t)) / 6 for t in found]
        best = max(range(len(found)), key=lambda k: (same[k], -k), default=None)
        if best is None or same[best] < ALIKE:
            found.append(words)
            want[text] = len(found) - 1
        else:
            found[best] = [a if a == b else "*" for a, b in zip(words, found[best])]
            want[text] = best
    assert dict(cluster([(t, 1) for t in texts])) == {t: " ".join(found[k]) for t, k in want.items()}


def _corpus(spark, cases):
    rows = [(i, t) for i, t in enumerate(NORMAL)] + [(1000 + 20 * k + i, f"{a} {b}") for k in range(1, 6) for i, (a, b) in enumerate(zip(NORMAL, NORMAL[k:] + NORMAL[:k]))] + list(cases.items())
    return {r["doc_id"] for r in residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_company_decides(spark):
    """Wordings without any cue, in languages of no list, are residue where they keep company with cued ones; cued ones in running text are not."""
    new = {
        2000: "404 Not Found. La pagina richiesta non esiste.", 2001: "503 Service unavailable. La pagina richiesta non esiste.", 2002: "La pagina richiesta non esiste.",
        2003: "Veuillez activer JavaScript. Rechargez ensuite cette vue.", 2004: "Rechargez ensuite cette vue.", 2005: "Il faut JavaScript ici. Rechargez ensuite cette vue.",
    }
    talk = "Without JavaScript the page stays blank, as we wrote."
    spoken = {3000 + i: f"{a} {talk} {b}" for i, (a, b) in enumerate(zip(NORMAL[::4], NORMAL[2::4]))}
    assert _corpus(spark, new | spoken) == set(new)


def test_templates_are_judged_as_one(spark, monkeypatch):
    """A template spreads what one of its texts shows to the others; with every unit its own template, those are lost."""
    words = ["amber", "basalt", "cobalt", "dunlin"]
    told = {2000 + i: f"404 Not Found. Nobody at all knows the way to room {w} in here." for i, w in enumerate(words)}
    alone = {2100: "Nobody at all knows the way to room ebony in here."}
    assert _corpus(spark, told | alone) == {*told, 2100}
    monkeypatch.setattr(module, "cluster", lambda units: [(u, u) for u, _ in units])
    assert _corpus(spark, told | alone) == set(told)


def test_wide_leaves_are_mined_in_parts(spark, monkeypatch):
    cases = {2000 + i: f"404 Not Found. Nobody at all knows the way to room {w} in here." for i, w in enumerate("amber basalt cobalt dunlin ebony fresco".split())}
    whole = _corpus(spark, cases)
    monkeypatch.setattr(module, "LEAF_UNITS", 2)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)  # shuffle joins find the same
    assert _corpus(spark, cases) == whole == set(cases)


def test_documents(spark):
    prose = " ".join(NORMAL[:3])
    cases = {
        1: prose + "\n\nSeed {{seed}} was rerun.", 2: "Menu\nSearch\n\n404 Not Found\n\nThe page may have been moved.", 3: "Please enable JavaScript to view the brain scene.", 4: "# Report\n\n## Results\n\nContent goes here.",
        5: "# Report\n\nzarn quilp vextor blimf dranz quorl snib.", 6: '{"error": {"code": 500, "message": "x"}}', 7: prose + "\n\n## Notes\n\nSomething went wrong",
    }
    fine = {
        20: prose, 21: prose + " The test expects the reply `Page not found` when the scene is unknown.", 22: prose + "\n```\nHTTP/1.1 503 Service Unavailable\n```", 23: None, 24: "", 25: "  \n ", 26: "TODO: rerun seed 7 once the queue is free.",
        27: prose + " The template spells the slot `{{seed}}` out.", 28: prose * 400,
    }
    rows = [(i, t, "clash") for i, t in {**cases, **fine, **{100 + i: t for i, t in enumerate(NORMAL)}}.items()] + [(50, cases[3], "clash")]
    got = residue(spark.createDataFrame(rows, "doc_id long, text string, reason string"))
    assert {r["doc_id"] for r in got.collect()} == {*cases, 50}
    assert residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_verdict_from_absence_in_few_texts(spark):
    said = ["Energy fell by 3 per minute while the fly was idle.", "Kolun zayıf satırları takas denetiminden sonra eşiği aşıyor.", "Fliege zeigt wieder diesen sonderbaren Geruch.", "Zeta motor neurons project bilaterally downwards."]
    langs = ["en", "tr", "de", None]
    few = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(said, langs))], "doc_id long, text string, lang string")
    assert residue(few, lang="lang").count() == 0
    strange = "zarn quilp vextor blimf dranz quorl snib."
    many = [(100 + i, t, "en") for i, t in enumerate(NORMAL)] + [(200 + i, f"{t} Row {i}", "EN ") for i, t in enumerate(NORMAL)]
    got = residue(few.unionByName(spark.createDataFrame(many + [(300, strange, "en"), (301, "dranz blimf korl vext snorb quilk.", "de")], few.schema)), lang="lang")
    assert {r["doc_id"] for r in got.collect()} == {300}  # a large corpus says nothing about the languages it has few texts of


def test_decomposed_letters():
    for text, reason in (("Das ist ein Füllabsatz.", "filler"), ("La sesión ha caducado.", "error"), ("Zaman aşımı oldu.", "error")):
        for form in ("NFC", "NFD"):
            ((_, line),) = text_lines(unicodedata.normalize(form, text))
            assert [cue(u) for u in units(line)] == [reason]


def test_what_is_said_of_words_is_kept(monkeypatch):
    calls = []
    known = module._Known(lambda w: calls.append(w) or len(w) > 1)
    assert [known[w] for w in ("a", "bc", "a", "bc")] == [False, True, False, True] and calls == ["a", "bc"]
    monkeypatch.setattr(module, "KEPT", 2)
    assert [known[w] for w in ("d", "a")] == [False, False] and len(known) <= 2
    before = len(module._MASKS), len(module._CLEAN)
    assert module.units("plain words Q99 here.") == module.units("plain words Q99 here.") == ["plain words * here"]
    assert (len(module._MASKS), len(module._CLEAN)) != before


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("in the END. Then 404. Not (here)", ["in the * then 4xx", "not here"]),
        ("todo (…) 3.5", ["todo … *"]),
        ("a , b (-) c", ["a  b - c"]),
        ("one - two?! three…. four", ["one", "two", "three…", "four"]),
        ("say <b>it</b> so. ", ["say", "it", "so"]),
        ("WAIT. ITEM X9! GO", ["wait", "item *", "go"]),
        ("1) end.\u2003next", ["end", "next"]),
    ],
)
def test_marks_and_cuts(line, want):
    assert module.units(line) == want
