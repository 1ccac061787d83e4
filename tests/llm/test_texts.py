import re
import re._constants as C
import re._parser as P
from itertools import product

import pytest

from memloom.llm import endings, pairs, residue


@pytest.mark.parametrize("text,want", [
    (None, "whole"), ("", "whole"), ("  ​", "whole"), ("N/A", "whole"), ("[No response]", "whole"), ("...", "whole"),
    ("It works.", "whole"), ("It works.”", "whole"), ("我们完成了。", "whole"), ("We saw it. See https://a.example/x-1", "whole"),
    ("We covered tea, milk and so on...", "whole"), ("It works. The next part of the lo", "cut"), ("It works. The ne…", "cut"),
    ("It works. The next�", "cut"), ("It works. The next [...]", "cut"), ("It works. And then he  ", "cut"), ("6 December 2025", "open"), ("Open points:\n- one\n- two", "open"),
    ("Done. Reference AB-1234", "open"), ("x" * 200 + ".", "whole"), ("The one thing that he said to them was that nobody", "cut"),
])
def test_endings(text, want):
    assert endings.judge(text)[0] == want


def test_cut_values_against_longer_copies(spark):
    rows = [
        ("a", "1", "Nobody told Mira that the plan had been moved to May."),
        ("a", "2", "Nobody told M"),
        ("a", "3", "Mira said yes"),
        ("b", "4", "Red Alpha bluebird, seen twice in Rome."),
        ("b", "5", "Red Alpha bluebi"),
        ("b", "5", "Red Alpha bluebi"),
        ("b", "6", None),
        (None, "7", "We met. Then the other pa"),
    ]
    df = spark.createDataFrame([("t", k, "f", s, t, "x") for s, k, t in rows], "tab string, rec_key string, field_name string, source string, text string, stem string")
    got = {r.rec_key: r.decider for r in endings.endings(df).collect()}
    assert got == {"1": None, "2": "value", "3": None, "4": None, "5": "value", "6": None, "7": None}
    # what goes on elsewhere, in another record, decides; only what leaves nothing to compare is told by its ending
    more = [("c", "8", "We saw it. Then the other path was closed for the day."), ("c", "9", "We saw it. Mira"), ("c", "10", "We saw it. Quite another thing tha"), ("c", "11", "We saw it. Nine plain plans of ..."), ("c", "12", "Then the other path was")]
    df = spark.createDataFrame([("t", k, "f", s, t, "x") for s, k, t in rows + more], df.schema)
    got = {r.rec_key: r.decider for r in endings.endings(df).collect()}
    assert {k: v for k, v in got.items() if v} == {"2": "value", "5": "value", "7": "sentence", "9": "ending", "11": "ending", "12": "sentence"}
    assert {(r.tab, r.decider): r.n_values for r in endings.deciders(endings.endings(df)).collect()} == {("t", "value"): 2, ("t", "sentence"): 2, ("t", "ending"): 2}
    rates = {r.source: (r.n_values, r.n_cut) for r in endings.cut_rates(endings.endings(df)).collect()}
    assert rates["a"] == (3, 1) and rates[None] == (1, 1)
    assert endings.endings(df.limit(0)).count() == 0


def test_prefix_join_is_exact_over_borders(spark):
    values = [("s" * k) + ("" if k % 3 else " end") for k in range(8, 60)] + ["alpha beta gamma", "alpha beta", "alpha bet", "alpha-beta!"]
    df = spark.createDataFrame([(v,) for v in values], "stem string")
    import re

    want = {v for v in set(values) if any(w.startswith(v) and re.match(r"[^\W_]|,? [^\W_]", w[len(v):]) for w in values if w != v) }
    got = {r.stem for r in endings.strict_prefixes(df, least=1).collect()}
    # a value continued in several ways is told by its first continuation in order
    assert got <= want and {"alpha beta", "alpha bet"} <= got and len(want - got) <= 2


def test_long_values_are_read_whole():
    import pyarrow as pa

    assert max(sum(c.isalnum() for c in s) for s in endings.STAND_INS) < 12
    markup = "<br class='abcdef'>" * 6
    for text in (" " + markup, "\n.. " + markup, "n/a" + " ." * 50, "null" + "-" * 90):
        assert not endings.bare(text), text
    for tail in ("." * 120, "-" * 101, " ..." * 40, "... [truncated]" * 9, "..." + "\"'" * 60):
        assert endings.judge("It works. The next part of the lo" + tail)[:2] == ("cut", "It works. The next part of the lo"), tail
    long, same = "x" * 200, "We met " + "y" * 80
    parts = [f"We {long} saw it in the old town.", f"{same} one of us in the town.", f"{same} and so it is in the town."]
    keys = pa.RecordBatch.from_pydict({"text": parts})
    got = set(next(endings._openings(iter([keys])))["opening"].to_pylist())
    assert got == {k for p in parts for n in range(1, 6) if (k := endings.opening_key(endings.skeleton(p), n))}


def test_prefix_join_reads_the_whole_run(spark):
    import re

    values = ["- The budget is", "- The budget is $500 a month", "- The budget is about 500", "- The budget is.", "- The plan"]
    values += [f"run of it{c}{k:03}" for k in range(150) for c in ("!", "-", " (")] + ["run of it", "run of it was long", "run of"]
    df = spark.createDataFrame([(v,) for v in values], "stem string")
    want = sorted(v for v in set(values) if any(w.startswith(v) and re.match(r"[^\W_]|,? [^\W_]", w[len(v):]) for w in values if w != v))
    assert "- The budget is" in want and "run of it" in want
    for least in (1, 8):
        assert sorted(r.stem for r in endings.strict_prefixes(df, least=least).collect()) == [v for v in want if len(v) >= least]


PAIRS = [
    ("What is the limit?", None, "empty"), ("What is the limit?", "<br>", "empty"), ("What is the limit?", "No.", None),
    ("What is the limit?", "WHAT IS THE LIMIT?", "copy"), ("What is the limit?", "You asked: What is the limit?", "copy"),
    ("What is the limit?", "You asked: What is the limit? It is 40.", None), ("What is the limit?", "The limit is 40 per minute and the", "truncated"),
    ("What is the limit of it?", "Das Budget ist nicht für den Plan von Rom.", "language"), ("What is the limit of it?", "It is what they call “der die das und nicht” here.", None),
    ("What is the limit?", "Sorry for the slow reply. The limit is 40.", None), ("What is the limit?", "I can't recall who said it, but here it is. The limit is 40.", None),
]
REFUSALS = [("What is the limit?", "I'm sorry, but I am not able to answer this question."), ("Who owns ticket AB-12?", "Unfortunately, I am not able to answer this question."), ("Where does Mira live?", "I am not able to answer this question. Please ask Tom instead.")]


def test_pair_defects(spark):
    rows = [("agent_responses", k, "answer", q, a) for k, (q, a, _) in enumerate(PAIRS)] + [("agent_responses", 100 + k, "answer", q, a) for k, (q, a) in enumerate(REFUSALS)]
    rows += [("fact_results", 1, "ground_truth", "What is the limit?", "forty of the"), ("fact_results", 2, "ground_truth", None, " "), ("fact_results", 3, "answer", None, "Yes"), rows[1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tab string, pair_id long, field_name string, question string, text string, opening string")
    got = {(r.tab, r.pair_id): r.defect for r in pairs.pair_defects(df).collect()}
    want = {("agent_responses", k): d for k, (_, _, d) in enumerate(PAIRS) if d} | {("agent_responses", 100 + k): "refusal" for k in range(3)} | {("fact_results", 2): "empty"}
    assert got == want
    assert pairs.pair_defects(df.limit(0)).count() == 0


def test_refusals_come_from_clusters(spark):
    """Variants of a refusal are one cluster; without clustering none recurs, so nothing is a refusal."""
    said = ["I'm sorry, but I am not able to comment on that.", "I am not able to discuss such requests.", "Unfortunately, I'm not able to reveal your question."]
    asked = ["Who owns the plan?", "When did we move the fair?", "How many people came?"]
    rows = [("agent_responses", k, "answer", q, a) for k, (q, a) in enumerate(zip(asked, said))]
    rows += [("agent_responses", 10 + k, "answer", "Which host keeps the old notes?", "I am unable to see it in there at all.") for k in range(30)]
    df = spark.createDataFrame(rows, "tab string, pair_id long, field_name string, question string, text string")
    assert {r.pair_id: r.defect for r in pairs.pair_defects(df).collect()} == {k: "refusal" for k in range(3)}
    assert pairs.pair_defects(df, clustering=False).count() == 0
    openings = spark.createDataFrame([(" ".join(pairs.opening_of(a)),) for a in said], "opening string")
    assert pairs.opening_clusters(openings).select("cluster").distinct().count() == 1


def test_similar_openings_are_verified_and_join_heads(spark):
    base = [f"w{k}" for k in range(40)]
    near, far = ["other", *base[1:]], [*base[:20], *[f"v{k}" for k in range(20)]]
    openings = spark.createDataFrame([(" ".join(o),) for o in (base, near, far, base[5:9], ["lone"])], "opening string")
    links = {(r.opening, r.leader) for r in pairs.similar_openings(openings).collect()}
    assert links == {(" ".join(base), " ".join(near))}
    got = {r.opening: r.cluster for r in pairs.opening_clusters(openings).collect()}
    assert got[" ".join(base)] == got[" ".join(near)] == got[" ".join(far)] and len(set(got.values())) == 3


DOCUMENTS = [
    ("Hello {{name}}, your export is ready.", True), ("Dear <CITY>, thanks.", True), ("Hello null, your budget of NaN USD is there.", True), ("Lorem ipsum dolor sit amet, consectetur.", True),
    ("404 Not Found", True), ('{"error": {"code": 500, "message": "bad gateway"}}', True), ("Please enable JavaScript and cookies in your browser.", True), ("请启用 JavaScript 以查看此页面。", True),
    ("Mira explained that the greeting uses `{{name}}` here.", False), ('We show "please enable JavaScript" to old browsers.', False), ("[Turn 3] User: hello there\nAssistant: hi", False),
    ('{"id": "a1", "type": "event", "content": "use {x} here"}', False), ("```python\nprint('{{x}}')\n```", False), ("", False), (None, False), ("  ", False), ("Please reload the page.", False), ("Our script and the error of 404 late rows were a null result.", False),
]


def test_residue(spark):
    """Each text in three documents of two sources, so that everything recurs and the rules decide."""
    rows = [(3 * k + copy, t, f"s{copy % 2}", 1) for k, (t, _) in enumerate(DOCUMENTS) for copy in range(3)] + [(0, DOCUMENTS[0][0], "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind int")
    got = {r.doc_id for r in residue.residue_documents(df).collect()}
    weak = [k for k, (t, _) in enumerate(DOCUMENTS) if t == "Please reload the page."]
    assert got == {3 * k + copy for k, (_, bad) in enumerate(DOCUMENTS) for copy in range(3) if bad or k in weak}
    assert residue.without_residue(df).where("doc_id = 0").count() == 0
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_recurrence_decides_for_every_class(spark):
    """One document is not enough, nor is one source; a placeholder or phrase that recurs in different messages is."""
    for text in ("Hello {{name}}, your export is ready.", "Lorem ipsum dolor sit amet, consectetur.", "404 Not Found", "Please enable JavaScript in your browser.", "Please reload the page."):
        for docs, sources, bad in ((1, 1, False), (2, 2, False), (3, 1, False), (3, 2, True)):
            df = spark.createDataFrame([(k, text, f"s{k % sources}") for k in range(docs)], "doc_id long, text string, source string")
            assert (residue.residue_documents(df).count() > 0) == bad, (text, docs, sources)
    parts = ["Hello {{name}}, we met.", "The owner of the plan is {{name}}.", "Call {{name}} on Monday."]
    df = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in enumerate(parts)], "doc_id long, text string, source string")
    got = residue.residue_messages(residue.hashed_messages(df)).collect()
    assert len(got) == 3 and all(r.by_core and not r.by_message for r in got)
    same = spark.createDataFrame([(1, "Ask {{a}} now. Ask {{b}} now. Ask {{c}} now.", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert residue.residue_documents(same).count() == 0


GAP = "\0"  # stands for whatever a rule leaves open


def _forms(items):
    """Every text a parsed rule can match, with gaps."""
    out = [""]
    for op, arg in items:
        if op is C.LITERAL:
            got = [chr(arg).lower()]
        elif op is C.IN:
            got = [chr(a).lower() for _, a in arg] if all(o is C.LITERAL for o, _ in arg) else [GAP]
        elif op is C.BRANCH:
            got = [f for branch in arg[1] for f in _forms(branch)]
        elif op is C.SUBPATTERN:
            got = _forms(arg[3])
        elif op is C.MAX_REPEAT:
            least, most, item = arg
            once = _forms(item)
            got = [""] * (least == 0) + (once if most == 1 else ["".join(p) + GAP for p in product(once, repeat=max(least, 1))] + ["".join(p) for p in product(once, repeat=max(least, 1))])
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            got = [""]
        else:
            assert op in (C.ANY, C.NOT_LITERAL), op
            got = [GAP]
        out = list(dict.fromkeys(a + b for a in out for b in dict.fromkeys(got)))
    return out


def test_every_phrase_rule_implies_a_trigger():
    assert not [t for t in residue.TRIGGERS if t in "<slot> <addr> <id>" or "0" in t]
    for kind, rule in [*residue.STRONG.items(), ("weak", residue.WEAK)]:
        assert not [f for f in _forms(P.parse(rule.pattern, rule.flags)) if not any(t in f for t in residue.TRIGGERS)], kind


def test_every_phrase_rule_implies_a_sign_of_its_own():
    for kind, rule in [*residue.STRONG.items(), ("weak", residue.WEAK)]:
        assert not [f for f in _forms(P.parse(rule.pattern, rule.flags)) if not any(t in f for t in residue.RULE_SIGNS[kind])], kind


@pytest.mark.parametrize("message,kinds", [("the gateway was planned for the choir", set()), ("he lives here", {"filler"}), ("an error of 0 rows", {"error"}), ("the page title of our script", {"script", "filler", "weak"})])
def test_a_rule_is_tried_only_on_messages_with_its_sign(monkeypatch, message, kinds):
    """A trigger of another rule, or a common word, does not send a message through all rules."""
    tried = set()

    class Noted:
        def __init__(self, kind, rule):
            self.kind, self.rule = kind, rule

        def search(self, text):
            tried.add(self.kind)
            return self.rule.search(text)

    monkeypatch.setattr(residue, "_RULES", {kind: Noted(kind, rule) for kind, rule in residue._RULES.items()})
    assert residue.classify(message, None) == ("", "") and tried == kinds


def test_masks_and_sentences_follow_their_definitions():
    """What is searched by signs equals the plain expressions, on pieces put together in every order."""
    pieces = ["TC-48300", "AB-12x", "ABCDE-12", "AB-CD-12", "aTC-12", "ab12cd", "1２ab3c", "éé1234", "x_1", "3.5:7", "12:123abc", "$35", "XX-AB-XX", "__a__", "%(k)s", "@@T@@", "null", "NaN", "me@x.org", "a.com", ".", "! ", "。", '"', "a", " "]
    ids = re.compile(r"\b[A-Z]{2,4}-\d+\b|\b(?=\w*\d)(?=\w*[A-Za-z])\w{6,}\b")
    quoted = re.compile(r"(?<![\w=])\"[^\"\n]{0,400}\"(?!\w)")
    for text in ("".join(p) for p in product(pieces, repeat=3)):
        plain = residue.EMPTY_FILL.sub("<slot>", residue.SLOT.sub("<slot>", text))
        plain = re.sub(r"\d+(?:[.,:/-]\d+)*", "0", ids.sub("<id>", residue.ADDRESS.sub("<addr>", plain)))
        assert residue.mask(text)[0] == " ".join(plain.split()).lower(), text
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*", quoted.sub(" ", text)) if p.strip()]
        assert [m for m, _, _ in residue.messages(text)] == [residue.mask(p)[0] for p in parts], text


@pytest.mark.parametrize("text,kind", [
    ("Write a short note in the space below.", "filler"), ("Type a short reply in the space provided", "filler"), ("Page\u00a0not \u2003found", "error"), ("You have been  logged\tout", "error"),
    ("More coming  soon", "filler"), ("Try  again", "weak"), ("Acceſs denıed", "error"), ("Unter ganz neuen Dingen stehen hier nur " + "lorem ipsum dolor sit amet " * 8, "filler"),
])
def test_phrase_rules_see_what_the_gate_passes(text, kind):
    assert kind in [residue.classify(m, slot)[0] for m, slot, may in residue.messages(text) if may]


def test_latin_reads_all_words():
    assert residue.latin("one two three four " + "dolor sit amet elit " * 5, residue.BASE_WORDS)


def test_learned_filler(spark):
    text = "Lorem velit arbor notum. Arbor notum velit lorem arbor. Ipsum velit notum arbor."
    df = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, "Arbor velit notum arbor velit.", "t"), (4, "The arbor of the town is old.", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == {1, 2, 3}
