"""Broken prompt and response pairs (problem 5), with the type of each defect.

Method: response openings (the whole first sentence without lead-ins such as apologies,
names and figures masked) are clustered by MinHash over five-word shingles, candidate
pairs verified at a Jaccard similarity of 0.8. Openings that begin with the same five words
share a shingle that no similarity of whole openings would find ("I am not able to" goes on
in many ways), so the first shingle is an item of its own, verified by being equal; clusters
are the connected components of both kinds of links. A cluster that recurs across unrelated
prompts is a template; a template that declines or reports that nothing is known, with no
answer beside it, is a refusal. Copy, language and termination checks label what remains.

Prompts are told apart by their first PROMPT_WORDS masked words. A cluster recurs across
unrelated prompts if it answers MIN_PROMPTS of them or more and no prompt has more than
TOP_SHARE of its responses, a share that does not move with the amount of data.

At most one defect per field, in this order: empty, copy, refusal, truncated, language.
``ground_truth`` is judged for empty, copy and language only.

Edge cases: a null or blank text is 'empty' whatever the question; with a null or blank
question only 'empty' and 'truncated' can be told; a repeated key counts once; texts of
any length are read whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import components
from memloom.llm.endings import SPLIT, bare, judge, skeleton
from memloom.session import materialize

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 8, 3
MIN_PROMPTS, TOP_SHARE, PROMPT_WORDS = 2, 0.9, 5  # what makes a recurring opening a template

# fixed values: lead-ins, signs of declining, polite tails, and words around a repeated question
LEAD = re.compile(
    r"^\s*(?:(?:i'?m|i am|we are) (?:very |so |really |afraid )?sorry|sorry|hmm+|well|(?:my )?apologies|i apologi[sz]e|unfortunately|regrettably|i'?m afraid|as an? (?:ai |language |virtual )*(?:assistant|model)|thank(?:s| you) for (?:asking|your question)|however|but"
    r"|(?:je suis )?désolée?|malheureusement|excusez-moi|merci pour la question|lo siento|por desgracia|lamentablemente|disculpe|gracias por preguntar|leider(?: gilt)?|(?:es )?tut mir leid|entschuldigung|danke für die frage|抱歉|很抱歉|非常抱歉|很遗憾|对不起|不好意思)(?![\w])?[\s,.:;!，。：—-]*",
    re.I,
)
DECLINES = {
    "en": re.compile(r"\b(?:can'?t|can’t|cannot|can not|couldn'?t|could not|unable|not (?:able|permitted|allowed|going|in a position|at liberty|something i can)|isn['’]t something|won['’]?t|would rather not|prefer not|declin\w+|refuse|no (?:record|information|mention|entry|usable|note|notes|data|details|idea|answer)|nothing|not a single|(?:do not|don['’]t|does not|doesn['’]t) (?:mention|have|know|contain|recall)|not (?:mentioned|available|found|known))\b", re.I),
    "fr": re.compile(r"\bje ne (?:peux|suis|sais|dispose|trouve|souhaite|vois|connais)|\bje n['’](?:ai|arrive)|m['’]est (?:impossible|interdit)|ne m['’]est pas|aucune? (?:trace|information|mention|note|donnée)|pas (?:autorisée?|en mesure|possible d)", re.I),
    "es": re.compile(r"\bno (?:puedo|tengo|me (?:está|es|consta)|dispongo|encuentro|sé|estoy|hay (?:ning|nada|informaci|registro|constancia))|ning[uú]n (?:registro|dato|apunte)|me es imposible|prefiero no", re.I),
    "de": re.compile(r"\b(?:kann|darf|möchte|werde|konnte|weiß) ich\b.*\b(?:nicht|nichts|keine?)\b|\bich (?:kann|darf|weiß|werde|möchte|habe|finde)\b.*\b(?:nicht|nichts|keine?n?)\b|liegt mir\b|ist mir (?:leider )?nicht|nicht (?:möglich|gestattet|erlaubt)", re.I),
    "zh": re.compile(r"无法|不能(?:回答|协助|帮助|提供|透露|评论|讨论|答复)|不便|不方便|没有(?:任何)?(?:相关)?(?:的)?(?:记录|信息|资料|内容)|没有找到|找不到|不清楚|不知道|未提及|没有提到|拒绝"),
}
SPEAKS = re.compile(r"\b(?:i|i['’]m|me|my|we|our|memory|notes?|conversation|chunks|turns|history|requests?|question|answer|topic|search|information|that|this|it)\b", re.I)
TAIL = re.compile(r"^\s*(?:please\b|kindly\b|perhaps\b|maybe\b|try\b|is there\b|let me know\b|you (?:may|can|could)\b|feel free\b|anything else|pouvez-vous|demandez|veuillez|pregunt|por favor|¿|bitte\b|frag\w*\b|versuch|请|换)", re.I)
HERE = re.compile(r"\b(?:but|mais|pero|aber) (?:here|voici|aquí|hier)\b|但(?:是)?(?:这|以下)", re.I)
AROUND = frozenset("you asked question user q query asks the is was your frage gefragt pregunta usuario utilisateur demande nutzer benutzer 问 题 用 户 你 您 的 是".split())

# fixed values: function words that tell the languages apart
FUNCTION_WORDS = {
    "en": "the and of is was are were that with this from they has have had his her which will would not it for been because before after than until on by an at as who what when where how why does did do how many".split(),
    "fr": "le les des est une dans pour pas que qui sur avec ce cette sont nous vous il elle ont été du au aux et ne se par quel quelle qui s'occupe d'ici où depuis grâce parce y personne quand quelle".split(),
    "de": "der die das und ist nicht ein eine einen mit für von zu den dem des auf sich wir sie es hat wird als auch bei nach aus wer wann wo welches welche welchen wie viel bis zum kennen durch seit haben um".split(),
    "es": "el los las una que es en por para con del al se su más pero como está fue son lo ha sus qué cuál quién dónde cuándo hay porque desde hace conocen nadie y lleva de".split(),
}
_TELLING = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}
HAN = re.compile(r"[㐀-鿿]")
LETTERS = re.compile(r"[^\W\d_]+")


def language(text: str) -> str:
    """en, fr, de, es, zh, or '' where the function words do not tell."""
    han = len(HAN.findall(text))
    words = [w.lower() for w in LETTERS.findall(re.sub(r"https?://\S+", " ", text)) if not HAN.search(w)]
    if han >= 2 and han >= len(words):
        return "zh"
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        for lang in _TELLING.get(w, ()):
            score[lang] += 1 / len(_TELLING[w])
    best = max(score, key=score.get)
    rest = max(v for k, v in score.items() if k != best)
    return best if score[best] >= 1.5 and score[best] >= 1.5 * rest else ""


def other_language(question: str, text: str) -> bool:
    """Whether every part of the text that tells its language is in another one than the question."""
    asked = language(question)
    whole = language(text)
    if not asked or not whole or whole == asked:
        return False
    return all(language(p) != asked for p in SPLIT.split(text) if p and p.strip())


def _words(text: str) -> list[str]:
    return re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", text.lower())


def copies(question: str, text: str) -> bool:
    """Whether the text says nothing beyond the question."""
    asked, said = _words(question), _words(text)
    if len(asked) < 2 or len(said) < len(asked):
        return False
    left, k, found = [], 0, False
    while k < len(said):
        if said[k : k + len(asked)] == asked:
            k, found = k + len(asked), True
        else:
            left.append(said[k])
            k += 1
    return found and len(left) <= 6 and all(w in AROUND for w in left)


def declining(text: str) -> str:
    """The first sentence without lead-ins if the whole text declines or knows nothing, else ''."""
    rest = text.strip()
    for _ in range(4):
        shorter = LEAD.sub("", rest, count=1)
        if shorter == rest:
            break
        rest = shorter
    parts = [p.strip() for p in SPLIT.split(rest) if p and p.strip()]
    if not parts or HERE.search(parts[0]):
        return ""

    def no(p: str) -> bool:
        return any(d.search(p) and (lang != "en" or SPEAKS.search(p)) for lang, d in DECLINES.items())

    if not no(parts[0]) or not all(TAIL.search(p) or no(LEAD.sub("", p)) for p in parts[1:]):
        return ""
    return parts[0]


def opening_of(text: str) -> list[str]:
    """Masked tokens of the first sentence without lead-ins."""
    rest = text.strip()
    for _ in range(4):
        rest = LEAD.sub("", rest, count=1)
    parts = [p for p in SPLIT.split(rest) if p and p.strip()]
    return [t for t in skeleton(parts[0].replace("I'm", "I am").replace("i'm", "i am")) if t not in ",:$"] if parts else []


def _shingles(opening: str) -> set[str]:
    words = opening.split(" ")
    return {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("prompt", "opening", "plain", "declines", "ending")}
        for field, question, text in zip(b.column("field_name").to_pylist(), b.column("question").to_pylist(), b.column("text").to_pylist()):
            asked = question or ""
            mask = skeleton(asked)
            opening = opening_of(text) if text and field == "answer" else []
            plain, declines, ending = "", False, "whole"
            if not bare(text):
                plain = "empty"
            else:
                if copies(asked, text):
                    plain = "copy"
                elif other_language(asked, text):
                    plain = "language"
                if field == "answer":
                    declines = declining(text) != ""
                    ending = judge(text)[0]
            out["prompt"].append(" ".join(mask[:PROMPT_WORDS]))
            out["opening"].append(" ".join(opening))
            out["plain"].append(plain)
            out["declines"].append(declines)
            out["ending"].append(ending)
        kinds = {"declines": pa.bool_()}
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("tab", "pair_id", "field_name")], *[pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()]],
            names=["tab", "pair_id", "field_name", *out],
        )


_MULTIPLY, _ADD = (np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64, endpoint=False) | np.uint64(1))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The MinHash bands of each opening of two shingles or more; one shingle is an item of its own already."""
    import xxhash

    for b in batches:
        names, keys = [], []
        for opening in b.column(0).to_pylist():
            shingles = _shingles(opening)
            if len(shingles) < 2:
                continue
            h = np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64)
            with np.errstate(over="ignore"):
                lows = (h[:, None] * _MULTIPLY + _ADD).min(axis=0)
            for k in range(BANDS):
                names.append(opening)
                keys.append(xxhash.xxh64_intdigest(lows[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64())], names=["opening", "band"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band and opening, each opening with the first of its band's leaders that is similar to it; others lead."""
    band, leaders = None, []
    for b in batches:
        ours, theirs = [], []
        for opening, key in zip(b.column("opening").to_pylist(), b.column("band").to_pylist()):
            if key != band:
                band, leaders = key, []
            mine = _shingles(opening)
            for name, shingles in leaders:
                if len(mine & shingles) >= SIMILAR * len(mine | shingles):
                    ours.append(opening)
                    theirs.append(name)
                    break
            else:
                leaders.append((opening, mine))
        yield pa.RecordBatch.from_arrays([pa.array(ours, pa.string()), pa.array(theirs, pa.string())], names=["opening", "leader"])


def similar_openings(openings: DataFrame) -> DataFrame:
    """(opening, leader): verified links between distinct openings that share a band."""
    bands = openings.select("opening").mapInArrow(_bands, "opening string, band long")
    return bands.repartition("band").sortWithinPartitions("band", "opening").mapInArrow(_verified, "opening string, leader string").distinct()


def _head(opening: str) -> Column:
    return F.array_join(F.slice(F.split(opening, " "), 1, SHINGLE), " ")


def opening_clusters(openings: DataFrame, clustering: bool = True) -> DataFrame:
    """(opening, cluster) for distinct openings; each is its own cluster if ``clustering`` is switched off."""
    if not clustering:
        return openings.select("opening", F.col("opening").alias("cluster"))
    # openings of one head are one cluster, so only links between heads are left to follow
    links = similar_openings(openings).select(_head("opening").alias("a"), _head("leader").alias("b")).where("a <> b").distinct()
    merged = components(links, "a", "b").withColumnsRenamed({"node": "head", "component": "root"})
    heads = openings.select("opening", _head("opening").alias("head"))
    return heads.join(merged, "head", "left").select("opening", F.coalesce("root", "head").alias("cluster"))


def templates(asked: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster): clusters that recur across unrelated prompts, of (opening, prompt, count)."""
    per_prompt = asked.join(clusters, "opening").groupBy("cluster", "prompt").agg(F.sum("count").alias("n"))
    spread = per_prompt.groupBy("cluster").agg(F.count("*").alias("prompts"), (F.max("n") / F.sum("n")).alias("top"))
    return spread.where((F.col("prompts") >= MIN_PROMPTS) & (F.col("top") <= TOP_SHARE)).select("cluster")


def pair_defects(pairs: DataFrame, clustering: bool = True) -> DataFrame:
    """(tab, pair_id, field_name, defect) of (tab, pair_id, field_name, question, text). Writes the features of the rows as a table first."""
    once = pairs.dropDuplicates(["tab", "pair_id", "field_name"])
    rows = materialize(once.select("tab", "pair_id", "field_name", "question", "text").mapInArrow(_features, "tab string, pair_id long, field_name string, prompt string, opening string, plain string, declines boolean, ending string"), "pairs")
    asked = rows.where("opening <> '' and plain <> 'copy'").groupBy("opening", "prompt").count()
    clusters = materialize(opening_clusters(asked.select("opening").distinct(), clustering), "openings")
    of_opening = clusters.join(templates(asked, clusters), "cluster", "left_semi").select("opening")
    # only declining rows ask whether their opening is a template, so no frequent answer opening is joined
    refusals = rows.where("declines").select("tab", "pair_id", "field_name", "opening").join(of_opening, "opening", "left_semi").select("tab", "pair_id", "field_name", F.lit(True).alias("refusal"))
    judged = rows.where("plain <> '' or declines or ending <> 'whole'").join(refusals, ["tab", "pair_id", "field_name"], "left")
    defect = (
        F.when(F.col("plain").isin("empty", "copy"), F.col("plain"))
        .when(F.col("refusal"), "refusal")
        .when(F.col("ending") == "cut", "truncated")
        .when(F.col("plain") == "language", "language")
    )
    return judged.select("tab", "pair_id", "field_name", defect.alias("defect")).where("defect is not null")


def as_pairs(fact_results: DataFrame, agent_responses: DataFrame) -> DataFrame:
    """Both tables in the form that ``pair_defects`` takes."""
    answers = fact_results.select(F.lit("fact_results").alias("tab"), F.col("result_id").cast("long").alias("pair_id"), F.lit("answer").alias("field_name"), "question", F.col("answer").alias("text"))
    truths = fact_results.select(F.lit("fact_results").alias("tab"), F.col("result_id").cast("long").alias("pair_id"), F.lit("ground_truth").alias("field_name"), "question", F.col("ground_truth").alias("text"))
    said = agent_responses.select(F.lit("agent_responses").alias("tab"), F.col("response_id").cast("long").alias("pair_id"), F.lit("answer").alias("field_name"), "question", F.col("answer").alias("text"))
    return answers.unionByName(truths).unionByName(said)
