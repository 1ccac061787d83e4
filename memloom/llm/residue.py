"""Problem 9: template residue, filler, error pages and notices about scripts in place of content.

Method: texts are cut into messages (sentences and lines, with code, inline code and
quoted speech taken out, since a document may talk about such things). In every message
numbers, dates, addresses, hosts, codes and slots are masked and its hash taken; equal
masked messages are one group across all documents and sources. Only then are groups
classified, each once: by placeholder rules (unfilled or emptily filled slots) and phrase
rules (filler, errors, script and cookie notices).

Recurrence decides for every class: a group is residue if the message recurs in
MIN_DOCS documents and MIN_SOURCES sources, or if its core does. The core of a message
with slots is the placeholder as it is written, of another one the phrase that the rule
found in it; many notices are put together from parts, and the core is the part that stays
the same. Phrases that could also be ordinary speech ('weak') count only where the whole
message recurs.

The text of a message travels to its group only if it holds a sign of some rule (a slot,
an empty fill, filler vocabulary, a trigger word); other messages cannot be classified and
are grouped by their hash alone. A phrase rule is tried only on messages that hold one of
its own signs, and a mask only where a sign of it stands.

Edge cases: null, empty and blank texts, and texts of fewer than MIN_CHARS characters,
are never cases; a document that is delivered twice counts once; transcript markers and
JSON records of artifacts are content; texts of any length are read whole; a leftover that
occurs in fewer documents than MIN_DOCS, message and core alike, is not told from content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import keep, materialize

MIN_CHARS = 5
MIN_DOCS, MIN_SOURCES = 3, 2

# fixed values: forms of unfilled slots
SLOT = re.compile(
    r"\{\{[#/^]?[^{}\n]{0,80}\}\}|\$\{[^{}\n]{1,80}\}|<%[=-]?[^%\n]{1,80}%>|\[\[[^\[\]\n]{1,60}\]\]|%\([A-Za-z_]\w*\)[sd]|#\{[^{}\n]{1,60}\}|<<[A-Za-z][\w ]{0,40}>>|@@[A-Za-z]\w*@@"
    r"|\$[A-Z][A-Z_]{2,}\$|%[A-Z][A-Z_]{2,}%|\b__[A-Za-z][A-Za-z_]*__\b|\bXX-[A-Z_]{2,}-XX\b|\[(?:INSERT|Insert|ENTER|Enter|ADD|Add)\s[^\]\n]{1,60}\]|\[(?:Your|YOUR|your)\s[^\]\n]{1,60}\]|\[[\w ]{1,40} (?:TBD|TBA|here|HERE)\]|<[A-Z][A-Z_ ]{2,40}>|(?<![{$#\"\w])\{[A-Za-z_]\w{0,40}\}(?!\})"
)
EMPTY_FILL = re.compile(r"\[object Object\]|(?<![\w\"'=:.])(?:undefined|null|NaN|nan|None)(?![\w\"'=(])")

_SCRIPTS = r"(?:java ?script|^script execution|\bJS\b|client-side scripts?|scripting|\bscripts\b|le script\b|skripte|脚本|\bcookies?\b)"
_DEMAND = r"(?:enabl|turn(?:ed)? (?:\w+ )?o(?:n|ff)|activat|allow|switch(?:ed)? (?:\w+ )?o(?:n|ff)|disabled|block|must be|need|requir|not (?:available|supported)|unavailable|works only|is off|are off|aktivier|deaktiviert|ohne|necesita|activ|habilit|veuillez|bloqué|désactiv|autoris|启用|禁用|开启|关闭|nécessaire|erforderlich)"
STRONG = {
    "script": re.compile(
        rf"{_SCRIPTS}.*{_DEMAND}|{_DEMAND}.*{_SCRIPTS}|\byour browser (?:does not|doesn't|is not|is too)\b|\b(?:outdated|unsupported) browser\b|\b(?:checking|verifying) (?:if |that )?(?:your browser|you are (?:a )?human|the site connection)|^(?:bitte )?browser wird überprüft|prove (?:that )?you are (?:a )?human|complete the captcha|vérification (?:de votre navigateur|que vous êtes humain)|comprobando (?:su|tu) navegador|正在(?:检查|验证)您",
        re.I,
    ),
    "error": re.compile(
        r"^\{\"error\"|<title>[^<]*(?:error|not found|forbidden|unavailable|bad gateway|denied|timeout)|^traceback \(most recent call last\)|^\s*error\s*:?\s*0\b|\b(?:http )?(?:error|fehler|erreur|错误代码|错误)\s*:?\s*(?:code|代码)?\s*0\b|^0 (?:not found|forbidden|internal server error|service unavailable|bad gateway|gateway time-?out|unauthorized|too many requests)|^(?:internal server error|bad gateway|service unavailable|gateway time-?out|access denied|forbidden|page not found)[.!]?$"
        r"|^seite nicht gefunden|^cette page est introuvable|^(?:esta )?página no (?:encontrada|existe)|^no se (?:encontró|ha encontrado) la página|页面不存在|找不到(?:该)?页面|服务(?:暂时)?不可用|^acceso denegado|^accès refusé|^zugriff verweigert"
        r"|you don['’]t have permission to (?:view|access|open)|(?:could|can)(?:n['’]t| not|not) (?:be served|find (?:what|the page)|load (?:this|the) (?:page|conversation|transcript))|returned an unexpected reply|closed the connection before|your session has expired|you have been logged out|scheduled maintenance|too many requests from|(?:page|transcript|conversation|session|file) (?:is no longer available|does not exist|has been removed|could not be (?:found|loaded))|we hit a snag|(?:link|address) you followed (?:may|might|is|has)|(?:page|transcript|conversation|session|file|export|view|link|document) (?:is no longer available|does not exist|has been (?:removed|renamed|deleted|moved)\b.*(?:problem|maintenance|error)|(?:is )?temporarily unavailable|failed to (?:open|load))|something went wrong|an unexpected error|this page (?:isn['’]t|is not) (?:available|working)|dienst ist (?:vorübergehend )?nicht (?:erreichbar|verfügbar)|service (?:est )?(?:temporairement )?indisponible|servicio (?:no (?:está )?disponible|temporalmente)|algo (?:ha salido|salió) mal|une erreur (?:est survenue|s['’]est produite)|ein fehler ist aufgetreten|出错了|temporarily (?:unavailable|down)|(?:ha ocurrido|se ha producido) un error|la sesión ha caducado|votre session a expiré|ihre sitzung ist abgelaufen|会话已(?:过期|失效)|^(?:key|value|timeout|connection|type|index|runtime|attribute)error:",
        re.I,
    ),
    "filler": re.compile(
        r"^lorem ipsum\b(?! (?:in|text|for|is|was)\b)|\blorem ipsum dolor|\bipsum dolor sit|\bdolor sit amet|consectetur adipi|^(?:this is )?dummy text|placeholder (?:copy|text) (?:for|goes|here)|^sample (?:paragraph|text)|(?:content|page|text|more) coming soon|^(?:add|write|insert|enter|type|describe|put|provide|fill in) (?:a |an |the |your |some |something |here)[^\"]{0,80}(?:here|description|sentences|space|text|content|summary|conversation|paragraph)|^your (?:text|title|content|name) (?:goes )?here|(?:text|title|titel|texte?|texto|título|titre) (?:hier|here|aquí|ici)\b|hier (?:eintragen|einfügen|ergänzen|steht)|texte d['’]exemple|aquí va el|texto de (?:muestra|ejemplo|relleno)|(?:beispiel|muster|platzhalter|blind)text|此处(?:填写|输入|插入)|示例文(?:字|本)|占位(?:文|符)|^(?:body text[ .]*){2,}|(?:asdf|qwer){1,}\b|\bfoo bar(?: baz)?\b|^(?:test ){2,}test|^(?:bla[ ,.]*){3,}|à remplacer\b|replace me\b|zu ersetzen\b|por completar\b|à compléter\b",
        re.I,
    ),
}
WEAK = re.compile(r"^(?:after that, )?(?:please )?(?:reload|refresh) (?:the|this) page|^(?:please )?(?:try again|retry)\b.{0,30}$|^(?:please )?(?:sign|log) in (?:again|with another|to (?:see|continue))|^(?:return|go back|back) to (?:the )?(?:start|home)|^zurück zur startseite|^retournez à l['’]accueil|^nothing can be displayed|^the chat viewer cannot start|^we will be back (?:shortly|soon)|^ask the owner for an invite|^slow down and retry|^tbd[.!]?$|^(?:titel|title|untitled)[.!]?$", re.I)

# fixed values: the usual filler text, and words that no filler sentence has
BASE_WORDS = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split())
PLAIN_WORDS = "the and for in is of to was with that this a it on by at as from le la les des est une pour que el los una por con der die das und ist ein für nicht".split()
FILLER_WORDS = 2_000  # bound of the learned vocabulary; the test data have about 30

# each form of each phrase rule contains one of these, as tests/llm/test_texts.py proves; most sentences have none
TRIGGERS = tuple(
    "script skript js cookie browser checking verifying human captcha vérification comprobando 脚本 正在 "
    "<title> traceback error fehler erreur 错误 gateway unavailable denied forbidden seite introuvable página encontr 页面 服务 acceso accès zugriff permission served find load unexpected connection expired maintenance exist followed temporarily failed snag dienst indisponible servicio algo 出错 caducado expiré sitzung 会话 unauthorized "
    "lorem ipsum dolor consectetur dummy placeholder sample description sentences text title titel título titre eintragen einfügen ergänzen hier aquí here exemple muestra ejemplo relleno muster beispiel 此处 示例 占位 asdf qwer bla remplacer ersetzen completar compléter "
    "reload refresh retry retournez invite tbd untitled".split()
) + ("not found", "logged out", "too many requests", "no longer available", "has been", "could not", "went wrong", "this page", "coming soon", "foo bar", "test test", "replace me", "try again", "sign in", "log in", "return to", "go back", "back to", "zurück zur", "nothing can", "cannot start", "be back", "slow down", "space", "content", "summary", "conversation", "paragraph")
# each form of a phrase rule contains one of the rule's own signs too, which are fewer
RULE_SIGNS = {
    "script": ("script", "skript", "脚本", "js", "cookie", "browser", "human", "captcha", "connection", "vérification", "comprobando", "正在"),
    "error": (
        "<title>", "error", "fehler", "erreur", "错误", "traceback", "not found", "forbidden", "unavailable", "unauthorized", "bad gateway", "gateway time", "denied", "too many requests", "seite", "introuvable", "página", "页面", "服务", "acceso", "accès", "zugriff",
        "have permission to", "be served", "find what", "find the", "load this", "load the", "failed to", "unexpected", "closed the", "expired", "logged out", "maintenance", "no longer available", "not exist", "has been", "could not", "snag", "followed", "temporarily", "went wrong", "this page", "dienst", "indisponible", "servicio", "algo", "出错", "caducado", "expiré", "sitzung", "会话",
    ),
    "filler": (
        "ipsum", "dolor", "consectetur", "text", "placeholder", "sample", "coming soon", "here", "description", "sentences", "space", "content", "summary", "conversation", "paragraph", "title", "titel", "título", "titre", "hier", "aquí", "此处", "示例", "占位", "asdf", "qwer", "foo bar", "test test", "bla",
        "remplacer", "ersetzen", "completar", "compléter", "replace me",
    ),
    "weak": ("reload", "refresh", "try again", "retry", "sign in", "log in", "return to", "back to", "seite", "retournez", "nothing can", "cannot start", "be back", "invite", "tbd", "title", "titel"),
}

# the signs of a mask begin with a character to search for, and say what may stand around it; FILLS and HOSTS are sought in a whole text
SLOT_SIGNS = re.compile(r"[{\[<$%@_X](?:(?<=[{\[<])|(?<=\$)[A-Z]|(?<=%)[A-Z(]|(?<=@)@|(?<=_)_|(?<=X)X-)")
SLOTS = ("{", "[", "<", "$", "%", "@@", "__", "XX-")
FILLS = ("undefined", "null", "NaN", "nan", "None", "[object")
HOSTS = ("://", "@", ".example", ".com", ".org", ".net")
DIGIT = re.compile(r"\d")
FILL_SIGNS = re.compile("undefined|null|NaN|nan|None|\\[object")
ADDRESS_SIGNS = re.compile(r"@|://|\w\.\w")
ID_SIGNS = re.compile(r"\d(?:(?<=[^\W\d]\d)|(?=[^\W\d]))")
ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.\w[\w.]*|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net)\b")
TICKET = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]{1,3}-\d+\b")
ID = re.compile(r"\b(?=\w*\d)(?=\w*[A-Za-z])\w{6,}\b")
NUMBER = re.compile(r"\d\d*(?:[.,:/-]\d+)*")

LATIN, PAGE = "<latin>", "<page> "  # a sentence of filler vocabulary, and the mark of a line that is an error record or page

FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
INLINE = re.compile(r"`[^`\n]*`|“[^”\n]{0,400}”|„[^“”\n]{0,400}[“”]|«[^»\n]{0,400}»|「[^」\n]{0,400}」|\"(?<![\w=]\")[^\"\n]{0,400}\"(?!\w)")
RECORD = re.compile(r"^\s*[\[{]\s*\"(?:id|type|content|obj_type|artifacts?)\"")
CODE_LINE = re.compile(r"^(?:\s{4,}|\t)\S|^\s*(?:def |class |return |import |from \w+ import |for \w+ in |if .*:$|const |let |var |function )")
SENTENCE = re.compile(r"\s(?<=[.!?]\s)\s*")
WIDE_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))
SPEAKER = re.compile(r"^\s*(?:\[Turn \d+\]\s*)?(?:User|Assistant|Q|A)\s*:\s*|^\s*(?:[-*•>]|\d{1,3}[.)])\s+|^\s*\[Turn \d+\]\s*")


@lru_cache(4)
def _encoded(words: frozenset[str]) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words)


def latin(part: str, words: frozenset[str]) -> bool:
    """Whether the part is made of filler vocabulary: four words or more, four fifths of them known."""
    said = part.lower().encode("utf-8", "replace").translate(LETTERS).split()
    return len(said) >= 4 and sum(map(_encoded(words).__contains__, said)) >= 0.8 * len(said)


def trigger_test() -> Callable[[str], bool]:
    """Whether a lower-case text holds a trigger: one pass of an automaton over all of them."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in TRIGGERS:
        found.add_word(t, t)
    found.make_automaton()
    return lambda low: next(found.iter(low), None) is not None


@lru_cache(1)
def _rule_test() -> Callable[[str], set[str]]:
    """The kinds of which a lower-case text holds a sign."""
    import ahocorasick

    kinds: dict[str, tuple[str, ...]] = {}
    for kind, signs in RULE_SIGNS.items():
        for t in signs:
            kinds[t] = (*kinds.get(t, ()), kind)
    found = ahocorasick.Automaton()
    for t, of in kinds.items():
        found.add_word(t, of)
    found.make_automaton()
    return lambda low: {kind for _, of in found.iter(low) for kind in of}


def _plain(low: str) -> str:
    """A lower-case text with the letters replaced that rules which ignore case take for s and i; its length stays."""
    return low if low.isascii() else low.replace("ſ", "s").replace("ı", "i")


def mask(text: str, slots: bool = True, fills: bool = True, hosts: bool = True) -> tuple[str, str | None]:
    """The message without slots, addresses, hosts, codes, ids, dates and numbers, one blank between words, lower case; and its first placeholder as written. What is said not to occur is not looked for."""
    slot = None
    if slots and SLOT_SIGNS.search(text):
        found = SLOT.search(text)
        if found:
            slot = NUMBER.sub("0", found.group()).lower()
            text = SLOT.sub("<slot>", text)
    if fills and FILL_SIGNS.search(text):
        said = EMPTY_FILL.findall(text)
        if len(said) >= 2 or "[object Object]" in said:
            slot = slot or said[0].lower()
        text = EMPTY_FILL.sub("<slot>", text)
    if hosts and ADDRESS_SIGNS.search(text):
        text = ADDRESS.sub("<addr>", text)
    if DIGIT.search(text):
        if "-" in text:
            text = TICKET.sub("<id>", text)
        if ID_SIGNS.search(text):
            text = ID.sub("<id>", text)
        text = NUMBER.sub("0", text)
    return " ".join(text.split()).lower(), slot


Message = tuple[str, str | None, bool]


def messages(text: str, words: frozenset[str] = BASE_WORDS, triggered: Callable[[str], bool] | None = None) -> list[Message]:
    """(masked message, placeholder, whether some rule might match) of each message."""
    triggered = triggered or trigger_test()
    slots, fills, hosts = (any(sign in text for sign in signs) for signs in (SLOTS, FILLS, HOSTS))
    out: list[Message] = []
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    for line in text.splitlines():
        if not line.strip() or RECORD.match(line):
            continue
        while said := SPEAKER.match(line):
            line = line[said.end() :]
        raw = line.strip()
        if raw.startswith('{"error"') or raw[:6].lower() == "<html>":
            out.append((PAGE + mask(raw)[0], None, True))
            continue
        if CODE_LINE.match(line):
            continue
        wide = not line.isascii()
        if wide or "`" in line or '"' in line:
            line = INLINE.sub(" ", line)
        for part in (WIDE_SENTENCE if wide and ("。" in line or "！" in line or "？" in line) else SENTENCE).split(line):
            part = part.strip()
            if not part:
                continue
            masked, slot = mask(part, slots, fills, hosts)
            low = " ".join(part.lower().split())
            if slot is None and latin(low, words):
                out.append((LATIN, None, True))
                continue
            out.append((masked, slot, slot is not None or triggered(_plain(low))))
    return out


def _case_free(rule: re.Pattern) -> re.Pattern:
    """The rule for what _plain() returns: tried faster, since case need not be ignored."""
    return re.compile(rule.pattern.replace("JS", "js"))


_RULES = {kind: _case_free(rule) for kind, rule in [*STRONG.items(), ("weak", WEAK)]}


def classify(message: str, slot: str | None) -> tuple[str, str]:
    """(class, core) of a masked message; class 'slot', 'script', 'error', 'filler', 'weak' or ''."""
    if slot is not None:
        return "slot", slot
    if message.startswith(PAGE):
        return "error", PAGE
    if message == LATIN:
        return "filler", LATIN
    low = _plain(message)
    kinds = _rule_test()(low)
    for kind, rule in _RULES.items() if kinds else ():
        found = kind in kinds and rule.search(low)
        if found:
            if kind == "weak":
                return kind, ""
            said = message[found.start() : found.end()].split()
            return kind, " ".join(said if len(said) <= 6 else [said[0], said[-1]])
    return "", ""


def filler_words(documents: DataFrame) -> frozenset[str]:
    """The vocabulary of sentences with "lorem" or "ipsum" and no plain word: at most FILLER_WORDS words. Runs."""
    sentence = F.explode(F.split(F.lower("text"), r"[\r\n]+|(?<=[.!?])\s+")).alias("s")
    said = documents.where(F.lower("text").rlike(r"\b(lorem|ipsum)\b")).select(sentence).where(F.col("s").rlike(r"\b(lorem|ipsum)\b") & ~F.col("s").rlike(r"\b(" + "|".join(PLAIN_WORDS) + r")\b"))
    words = said.select(F.explode(F.regexp_extract_all("s", F.lit("([a-z]{3,})"), 1)).alias("w")).groupBy("w").count().where("count > 2")
    return BASE_WORDS | {r.w for r in words.orderBy(F.desc("count"), "w").limit(FILLER_WORDS).collect()}


def _hashed(words: frozenset[str]):
    """Each document's different messages, hashed; with their text where a rule might match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        triggered = trigger_test()
        for b in batches:
            ids, sources, keys, texts, slots = [], [], [], [], []
            for doc, source, text in zip(*[b.column(k).to_pylist() for k in range(3)]):
                if text is None or len(text.strip()) < MIN_CHARS:
                    continue
                seen = set()
                for masked, slot, may in messages(text, words, triggered):
                    key = xxhash.xxh64_intdigest(masked) - (1 << 63)
                    if (key, slot) in seen:
                        continue
                    seen.add((key, slot))
                    ids.append(doc)
                    sources.append(source)
                    keys.append(key)
                    texts.append(masked if may else None)
                    slots.append(slot)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(slots, pa.string())], names=["doc_id", "source", "key", "message", "slot"])

    return run


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [classify(m, s) for m, s in zip(b.column("message").to_pylist(), b.column("slot").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*b.schema.names, "kind", "core"]).filter(pa.array([g[0] != "" for g in got], pa.bool_()))


def hashed_messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, key, message, slot): the different masked messages of each document. Learns the filler vocabulary and writes a table."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return materialize(texts.mapInArrow(_hashed(filler_words(texts)), "doc_id long, source string, key long, message string, slot string"), "messages")


def message_groups(hashed: DataFrame) -> DataFrame:
    """(key, message, slot, n_docs, n_sources) of each group of equal masked messages; the message is null where no rule can match."""
    per_source = hashed.groupBy("key", "source").agg(F.min("message").alias("message"), F.min("slot").alias("slot"), F.countDistinct("doc_id").alias("n"))
    return per_source.groupBy("key").agg(F.min("message").alias("message"), F.min("slot").alias("slot"), F.sum("n").alias("n_docs"), F.count("*").alias("n_sources"))


def residue_messages(hashed: DataFrame) -> DataFrame:
    """(doc_id, source, key, message, kind, core, by_message, by_core): the messages that a rule classifies, and what recurs of them."""
    groups = message_groups(hashed).where("message is not null").mapInArrow(_classified, "key long, message string, slot string, n_docs long, n_sources long, kind string, core string")
    kinds = groups.select("key", "kind", F.col("core").alias("phrase"), ((F.col("n_docs") >= MIN_DOCS) & (F.col("n_sources") >= MIN_SOURCES)).alias("recurs"))
    found = keep(hashed.where("message is not null").join(kinds, "key").select("doc_id", "source", "key", "message", "kind", F.coalesce("slot", "phrase").alias("core"), "recurs"))
    cores = found.where("core <> ''").select("core", "source", "doc_id").distinct().groupBy("core", "source").agg(F.count("*").alias("n")).groupBy("core").agg(F.sum("n").alias("n"), F.count("*").alias("s"))
    wide = cores.where((F.col("n") >= MIN_DOCS) & (F.col("s") >= MIN_SOURCES)).select("core", F.lit(True).alias("wide"))
    return found.join(wide, "core", "left").select("doc_id", "source", "key", "message", "kind", "core", F.col("recurs").alias("by_message"), F.coalesce("wide", F.lit(False)).alias("by_core"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds): documents with residue, and the sorted kinds of it."""
    bad = residue_messages(hashed_messages(documents)).where("by_message or by_core")
    return bad.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are left when those with residue are excluded."""
    return documents.join(residue_documents(documents).select("doc_id"), "doc_id", "left_anti")
