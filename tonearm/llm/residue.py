"""Template residue, filler, error pages and script notices in mail (problem 8).

Each message becomes its sender's own words (tonearm.llm.mail) and then sentences. A sentence with an unfilled
placeholder is residue unless each is quoted or stands directly by words that speak about it. Sentences that are, as a whole,
filler, an error message or a script notice are residue if such sentences make up at least half of the body.

All bodies are hashed with numbers, addresses, dates and placeholders masked, and the hashes are counted over the
corpus. A group of equal hashes, groups of one included, is classified by the rules above; a group that no rule knows
is residue if it recurs, isn't a letter (no greeting or farewell), and holds one of the wider phrases of its kind.
Recurring means two messages or more, whatever their sources, and at least ``rate`` of all bodies; copies of one message
that were delivered again count once. At last each message of a group must pass the rules itself.

Null, empty and blank texts, and mails that only quote, are no cases. Whole texts are read, whatever their length.
Repeated rows give one doc_id. Null sources count as one source.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.mail import own
from tonearm.shared import cut

#: Least share of all bodies that a recurring body has.
RATE = 2e-5

#: Words that name a value to be filled in.
FIELDS = "name|names|nombre|prenom|vorname|nachname|nom|firstname|lastname|fname|lname|customer|client|user|member|recipient|company|firma|address|street|city|ville|ciudad|stadt|ort|country|branch|room|date|datum|fecha|day|time|year|due|price|amount|total|sum|betrag|montant|importe|order|orderno|ref|reference|number|no|id|item|items|list|album|artist|product|title|agent|owner|contact|signature|team|link|url|website|email|mail|phone|code|password|tracking|ship|shipping|job|position|department|your|insert|here|placeholder|value|text|subject"
# Every part of these patterns can match in one way only: a repeated group with an optional separator never ends on long words.
_NAME = r"\s*[A-Za-z_][\w\s.\-|:]*"
STRONG = re.compile(
    rf"\{{\{{\{{{_NAME}\}}\}}\}}|\{{\{{{_NAME}\}}\}}|\{{%[^%\n]+%\}}|<%=?[^%\n]+%>|[$#]\{{{_NAME}\}}|@@{_NAME}@@|\[\[{_NAME}\]\]|<<{_NAME}>>|\*\|{_NAME}\|\*|%%{_NAME}%%"
    r"|\[(?:INSERT|Insert|ENTER|Enter|ADD|FILL)\s[^\[\]\n]+\]|\[[^\[\]\n]+ (?:einsetzen|eintragen|einfügen|hier|here|aquí|ici)\]|\[(?:insérer|insertar|indiquer|indicar) [^\[\]\n]+\]"
    r"|\([\w. ]+ (?:TBC|TBD|TBA|to be confirmed|to be added)(?: BY \w+)?\)|<[\w. ]+ here>|&lt;[\w. ]+&gt;"
)
_OPEN = r"[\w .-]+"
_WEAK = re.compile(rf"(?<![\w$])(?:\{{({_OPEN})\}}|%({_OPEN})%|\[({_OPEN})\]|<({_OPEN})>|~({_OPEN})~|\$([\w.]+)\$|\$({_OPEN})\$|__({_OPEN})__|«({_OPEN})»)(?!\w)")
_HOLDS = re.compile(rf"(?:^|[ ._-])(?:{FIELDS})", re.I)
_HOLDS_INSIDE = re.compile(FIELDS, re.I)


class WEAK:
    """Marks that are placeholders only around a word that names a value."""

    @staticmethod
    def holds(m: re.Match) -> bool:
        return bool(_HOLDS_INSIDE.search(m[6]) if m[6] else _HOLDS.search(m[m.lastindex]))

    @classmethod
    def finditer(cls, text: str) -> Iterator[re.Match]:
        return (m for m in _WEAK.finditer(text) if cls.holds(m))

    @classmethod
    def sub(cls, mark: str, text: str) -> str:
        return _WEAK.sub(lambda m: mark if cls.holds(m) else m[0], text)


#: What stands directly before or after a placeholder that is spoken about.
_THING = r"template|vorlage|mod[eè]le|modelo|plantilla|preset|pattern|script|manual|form"
_MARK = r"placeholder|platzhalter|variable|marcador|espace réservé|syntax|field code|field"
MENTION_BEFORE = re.compile(
    rf"(?:\b(?:came|comes?|shows? up|printed|appears?) (?:out )?as|\b(?:calls?|runs?|starts?|invokes?) [^,;]{{0,30}}\bwith|\b(?:{_MARK})s?(?: (?:is|called|named|like|namens))?"
    rf"|\b(?:{_THING})s?\b(?: \w+){{0,2}} (?:contains?|says?|uses?|reads?|shows?|calls?)|\b(?:template|preset|pattern)s?\b(?: \w+){{0,3}} is|\bvorlage (?:steht|enthält)(?: \w+)?|\b(?:{_THING}) (?:contient|contiene|dice|dit|utilise|usa)|\bhas to become|\bknow what|\bmeaning of)[ :]*$",
    re.I,
)
MENTION_AFTER = re.compile(rf"\s*(?:stands? for|means?\b|has to become|is (?:then )?replaced|gets? replaced|into the (?:text|template|body|form)|is (?:a|the|our) (?:{_MARK})|in (?:the|our|my|this) (?:\w+ )?(?:template|vorlage|preset|mailing)\b)", re.I)
#: Words between the placeholders of one list or pattern, and the placeholders themselves.
_LINKS = re.compile(r"|[-–/|&+]|and|or|und|oder|et|ou|y|o|[^\s,]*[{}%<>$\[\]][^\s,]*")
_QUOTES = "\"'“”„«»‘’‹›`"

#: Words of the usual filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FILLER = re.compile(
    r"(?:asdf|qwer(?:ty)?|jkl[öä;]?|xxx+|test|foo|bar|bla|blah|dummy)(?: (?:asdf|qwer(?:ty)?|jkl[öä;]?|xxx+|test|foo|bar|bla|blah|dummy))*"
    r"|(?:headline|title|text|body copy|copy|image|caption|content) goes here\b.*|add your \w+ here|replace this (?:paragraph|text|line).*|(?:sample|dummy|placeholder) text\b.*|(?:picture|image) caption to follow|call to action button label|your (?:text|headline|title) here"
    r"|hier steht (?:später|bald) .*text|(?:platzhalter|blindtext|mustertext)\b.*|texte? provisoire.*|texte? de remplacement.*|texto de relleno\b.*|texto de ejemplo\b.*",
    re.I,
)
ERROR = re.compile(
    r"(?:http )?(?:error |fehler |erreur )?[45]\d\d:? (?:bad request|unauthori[sz]ed|forbidden|not found|method not allowed|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
    r"|(?:error|fehler|erreur) [45]\d\d ?:.*|the (?:requested|archive|page|server)\b.*(?:could not be (?:delivered|found)|returned [45]\d\d).*|access to \S+ is denied|access denied|too many requests|could not connect to .*|message body not available|your session has expired|this mailbox is over its limit.*"
    r"|(?:warning|fatal error|notice|parse error|uncaught \w+): .*(?: on line \d+|\.\w+:\d+).*|traceback \(most recent call last\).*|internal server error|service unavailable|bad gateway|.*nicht gefunden oder ist vorübergehend nicht verfügbar|.*n['’]est pas disponible|.*no está disponible en este momento",
    re.I | re.S,
)
SCRIPTS = re.compile(
    r"(?:this page|this site|this app|this message|the archive) (?:needs|requires) (?:scripts?|javascript).*|(?:you need to|please|you must) (?:enable|turn on|activate|allow) (?:javascript|scripts?|cookies).*|enable them and reload|(?:javascript|scripts?)(?: and cookies)? (?:is|are|must be) (?:required|needed|disabled|allowed|enabled).*|cookies and scripts must be allowed|bitte aktivieren sie javascript.*|veuillez activer javascript.*|(?:por favor )?activ[ea] javascript.*|ative o javascript.*|checking your browser.*|your (?:mail reader|browser) (?:blocks|does not support) (?:active content|scripts?|javascript).*",
    re.I,
)
WIDER = re.compile(r"\b(?:error|fehler|erreur|denied|forbidden|unavailable|timed? ?out|expired|not available|not be (?:shown|displayed|delivered|found|stored)|over (?:its|quota)|too many|try again|reload|reference [0-9a-f]{6,}|javascript|scripts?|cookies|enable|blocked|sample text|goes here|placeholder|teaser|to follow|provisoire|remplacer|relleno|platzhalter|mustertext)\b", re.I)
LETTER = re.compile(r"(?m)^(?:(?:hi|hello|dear|hallo|liebe[rs]?|guten|bonjour|salut|hola|buenos|querid[oa]|olá|ciao)\b.{0,60}[,:\-]?|(?:best|thanks|cheers|regards|kind regards|gruß|viele grüße|mit freundlichen grüßen|merci|cordialement|à bientôt|saludos|gracias|un saludo)[,!]?)\s*$", re.I)
#: Notices that mail systems add below a message.
TRAILERS = re.compile(r"(?:the views in this mail are those of the sender.*|no liability is taken for .*|please (?:think of|consider) the (?:trees|environment).*|gateway|request id \w+|reference \w+|\(\d+\)|try again in .*|sign in again .*|slow down and reload .*)", re.I)
_MASKS = ((re.compile(r"\S+@\S+"), "<mail>"), (re.compile(r"(?:https?://|/)\S+"), "<at>"), (STRONG, "<value>"), (WEAK, "<value>"), (re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b"), "<id>"), (re.compile(r"\d+(?:[.,:/-]\d+)*"), "<n>"), (re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b", re.I), "<n>"), (re.compile(r"\W+"), " "))


def masked(body: str) -> str:
    for pattern, mark in _MASKS:
        body = pattern.sub(mark, body)
    return body.strip().lower()


def sentences(body: str) -> list[str]:
    found = []
    for paragraph in re.split(r"\n\s*\n", body):
        for line in re.split(r"(?<=[.!?:])\s+(?=\S)", re.sub(r"\s+", " ", paragraph).strip()):
            if line:
                found.append(line)
    return found


def unfilled(sentence: str) -> bool:
    """Whether a placeholder stands in it for a value, not for itself."""
    hits = list(STRONG.finditer(sentence))
    hits += [m for m in WEAK.finditer(sentence) if not any(s.start() <= m.start() < s.end() for s in hits)]
    if not hits:
        return False

    def mentioned(m: re.Match) -> bool:
        before, after = sentence[max(0, m.start() - 2) : m.start()].strip()[-1:], sentence[m.end() : m.end() + 2].strip()[:1]
        if before and after and before in _QUOTES and after in _QUOTES:
            return True
        words, next_ = sentence[max(0, m.start() - 80) : m.start()].split(" "), sentence[m.end() : m.end() + 80].split(" ")
        while words and _LINKS.fullmatch(words[-1]):
            words.pop()
        while len(next_) > 1 and _LINKS.fullmatch(next_[0]):
            next_.pop(0)
        return bool(MENTION_BEFORE.search(" ".join(words)) or MENTION_AFTER.match(" ".join(next_)))

    return not all(mentioned(m) for m in hits)


def kind(sentence: str) -> str:
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    if len(words) >= 3 and sum(w in LOREM for w in words) >= 0.75 * len(words):
        return "filler"
    bare = sentence.strip(" \t.!\"'")
    for name, pattern in (("filler", FILLER), ("error", ERROR), ("scripts", SCRIPTS), ("trailer", TRAILERS)):
        if pattern.fullmatch(bare):
            return name
    return "other"


def verdict(text: str | None) -> tuple[str | None, bool, int] | None:
    """(kind of residue by the strict rules, whether wider phrases apply, hash of the masked body); None: no words."""
    body = own(text)
    if not body:
        return None
    letter = bool(LETTER.search(body))
    found = None
    if any(unfilled(s) for s in sentences(body)):
        found = "placeholder"
    else:
        size = {"filler": 0, "error": 0, "scripts": 0, "other": 0, "trailer": 0}
        for paragraph in re.split(r"\n\s*\n", body):
            whole = re.sub(r"\s+", " ", paragraph).strip()
            if (k := kind(whole)) not in ("other", "trailer"):
                size[k] += len(whole)
                continue
            # lines may end sentences or only wrap them: the reading that knows more of the paragraph counts
            ways = [[x for line in paragraph.split("\n") for x in sentences(line)], sentences(paragraph)]
            readings = [[(kind(s), len(s)) for s in each] for each in (ways if ways[0] != ways[1] else ways[:1])]
            for k, n in max(readings, key=lambda r: sum(n for k, n in r if k not in ("other", "trailer"))):
                size[k] += n
        name = max(("filler", "error", "scripts"), key=lambda k: size[k])
        if size[name] and sum(size[k] for k in ("filler", "error", "scripts")) >= size["other"]:
            found = name
    return found, found is None and not letter and bool(WIDER.search(body)), xxhash.xxh3_64_intdigest(masked(body)) - (1 << 63)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = [verdict(t) or (None, False, None) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("message"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "source", "message", "rule", "wider", "body_hash"])


def judged(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, source, kind (null for ordinary mail) and body_hash of every document."""
    key = F.col("doc_id").cast("string")
    message = F.coalesce("message_ref", key) if "message_ref" in docs.columns else key
    texts = docs.select("doc_id", "source", message.alias("message"), "text")
    rows = cut(texts.mapInArrow(_judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, message string, rule string, wider boolean, body_hash bigint"))
    bodies = rows.filter("body_hash is not null")
    groups = bodies.groupBy("body_hash").agg(F.countDistinct("message").alias("n"), F.max("rule").alias("group_rule"), F.max("wider").alias("group_wider"))
    recurs = F.col("group_wider") & (F.col("n") >= max(2, math.ceil(bodies.count() * rate)))
    classed = groups.select("body_hash", F.when(F.col("group_rule").isNotNull(), F.col("group_rule")).when(recurs, F.lit("recurring")).alias("class"), recurs.alias("recurs")).filter("class is not null")
    checked = F.when(F.col("class").isNotNull() & F.col("rule").isNotNull(), F.col("rule")).when(F.col("recurs") & F.col("wider"), F.lit("recurring"))
    known = bodies.join(classed, "body_hash", "left").select("doc_id", "source", checked.alias("kind"), "body_hash")
    return known.unionByName(rows.filter("body_hash is null").select("doc_id", "source", F.lit(None).cast("string").alias("kind"), "body_hash"))


def found(docs: DataFrame) -> DataFrame:
    return judged(docs).filter("kind is not null").select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The archive without the cases; all columns kept."""
    return docs.join(found(docs), "doc_id", "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """How many documents of each source hold which kind of residue."""
    return judged(docs).groupBy("source", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.countDistinct("doc_id").alias("documents"))
