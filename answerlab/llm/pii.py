"""Personal information inside free text: weak-supervision aggregation.

Candidate spans of each kind come from wide patterns and, for names, from the gazetteer too; a candidate is not judged where it
is found.  Labelers that look at different things (form, number plan or gazetteer, words before, words after, letter case, ordinary words)
vote for, against or abstain, and often disagree.  The votes of *all* candidates are counted by vote pattern; expectation-maximisation
over those counts estimates each labeler's reliability and each pattern's posterior without any labelled text, and a
regularised logistic span classifier on votes and span features (length, number of words, case of the text) is trained on the
posteriors.  The numbers of patterns are bounded by the labelers and features, so the counts that reach the driver do not grow with
the data.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.session import materialize

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# All patterns run on the lower-cased text.
# ---- e-mail addresses
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_WORD_DOT = r"(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_PART = r"[a-z0-9_+%-]+"
#: With a bare "at" the dots of the host must be words too, or prose about web sites would match.
_EMAIL = re.compile(
    rf"(?<![\w.+@-]){_PART}(?:{_DOT}{_PART})*(?:{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}|\sat\s[a-z0-9-]+(?:{_WORD_DOT}[a-z0-9-]+)*{_WORD_DOT})"
    r"[a-z]{2,}(?![\w@])"
)
_EMAIL_BEFORE = re.compile(r"(?P<yes>e-?mail|contact|reach|write|wrote|writing|send|sent|message|address|answer|reply|replied)|(?P<no>web|site|page|visit|handle|link|url|profile)")
#: Common endings of host names.
_ENDINGS = frozenset("com org net edu gov mil info biz io co us uk ca eu de fr es it example test".split())

# ---- phone numbers
_SEP = r"[ .\-–—/]"
_PHONE = re.compile(
    rf"(?<![\w.$/+-])(?:\+\d{{1,3}}{_SEP}?(?:\(?\d{{2,4}}\)?{_SEP}?){{2,3}}\d{{3,4}}"
    rf"|(?:1{_SEP}?)?(?:\(\d{{3}}\)|\d{{3}}){_SEP}?\d{{3}}{_SEP}?\d{{4}})(?![\w$]|{_SEP}\d)"
)
#: Digit words.
_DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
#: Stretches of digits and the signs between them; phone and bare identity numbers lie inside one.
_NUMERIC = re.compile(r"[+(\d][\d().+ \-–—/]{7,}\d")
#: A number that may be a house number: not part of a sum, date, time or longer number.
_NUMBER = re.compile(r"\d+(?![\d./:%])")
_SPELLED = re.compile(rf"\b(?:(?:plus|one)\W{{1,2}})?(?:{_DIGITS})(?:[ ,-]{{1,2}}(?:{_DIGITS})){{6,12}}\b")
#: Words that say what the number after them is, the nearest counting.
_NUMBER_KIND = (
    [(w, "phone") for w in ("phone", "cell", "mobile", "tel ", "tel.", "tel:", "telephone", "call", "dial", "reach", "text", "fax", "ring", "rang", "contact", "my number is", "hotline")]
    + [(w, "id") for w in ("ssn", "s.s.n", "social", "tax", "itin", "passport", "licen", "state id", "state i.d", "identity")]
    + [(w, "other") for w in ("account", "acct", "card", "case", "reference", "ref ", "ref.", "ref:", "ref#", "tracking", "parcel", "invoice", "batch", "order", "claim", "ticket",
        "confirmation", "routing", "serial", "policy", "member", "loan", "check")]
)
_CLAUSE_END = re.compile(r"\s*(?:[.,;:!?)|\n]|\Z)")
_EXTENSION = re.compile(r"\s*,?\s*(?:ext|x\d)")
_AMOUNT_AFTER = re.compile(r"\s*(?:dollars|usd|percent|%|points|miles)")

# ---- identity numbers
_ID_WORD = (
    r"(?:ssn|s\.s\.n\.|social(?:\s+security)?|tax(?:payer)?(?:\s*(?:id(?:entification)?|i\.d\.))?|itin|passport"
    r"|driver(?:['’]?s|s['’])?\s+licen[cs]e|driving\s+licen[cs]e|licen[cs]e|state\s+(?:id|i\.d\.)|identity\s+card)"
)
_ID = re.compile(
    rf"\b{_ID_WORD}(?:\s+(?:number|no\.?|num\.?|id|card|#))*\s*(?:is|was|of|as|:|#)?\s*[:#]?\s*"
    r"((?:[a-z]{1,2}[ -]?)?\d(?:\s?[-.]\s?|\s)?(?:[\da-z](?:\s?[-.]\s?|\s)?){5,13}\d)(?![\w-])",
)
_BARE_SSN = re.compile(r"(?<![\w.$/-])\d{3}(?:\s?[-.]\s?|\s)\d{2}(?:\s?[-.]\s?|\s)\d{4}(?![\w-])")
_ID_SHAPE = re.compile(r"\d{9}|[a-z]\d{8}|[a-z]\d{11}|[a-z]{1,2}\d{6,12}|\d{8}|\d{10}")

# ---- street addresses
_TYPE = (
    r"(?:street|st|avenue|ave|av|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|place|pl|way|terrace|ter|trail|trl|circle|cir"
    r"|square|sq|parkway|pkwy|pike|row|loop|alley|highway|hwy|plaza|crescent|close|walk|path|run|ridge|hill|point|crossing|turnpike|bend|cove|mews)"
)
_WORD_NUMBER = (
    r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    r"|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?)"
)
_HOUSE = rf"(?:\d{{1,5}}(?:[ ]?1/2)?(?:-?[a-z](?![a-z]))?(?:\s?[-–]\s?\d{{1,5}}[a-z]?)?|{_WORD_NUMBER})"
_DIR = r"(?:(?:north|south|east|west)(?:east|west)?|[ns]\.?\s?[ew]\.?|[nsew]\.?)"
_NAME = r"(?:\d{1,3}(?:st|nd|rd|th)|[^\W\d_][^\W\d_'’]+)"
_ROUTE = r"(?:state|county|u\.?s\.?|rural|farm|old|interstate)?\s?(?:route|road|highway|hwy\.?|rte\.?|rt\.?)\s\d{1,4}[a-z]?"
#: Street types that stand before the name (Spanish, French, Italian, Portuguese).
_FIRST_TYPE = r"(?:calle|avenida|avda\.?|camino|paseo|carrera|plaza|rue|chemin|boulevard|via|viale|piazza|rua)\s(?:(?:de|del|des|du|da|do|dos|di|la|las|los|el|les)\s){0,2}"
#: A type after which another may follow (Hill Lane), and what may follow.
_LAST_TYPE = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|place|pl|way|terrace|ter|trail|circle|cir|square|sq|parkway|pkwy|pike|row)"
_ADDRESS = re.compile(
    rf"(?<![\w$./:#-])({_HOUSE}),?\s+(?:({_ROUTE}|{_FIRST_TYPE}[^\W\d_][^\W\d_'’]+)|(?:{_DIR}\s+)?({_NAME}(?:\s+[a-z][a-z'’]+){{0,2}}?)\s+{_TYPE}\b\.?(?:\s+{_LAST_TYPE}\b\.?)?)(?:\s+[ns][ew]?\b\.?(?=\s*[,\n|]))?"
)
#: A street name that holds its type, or has none: only where the words around may say it is an address.
_ADDRESS_BEFORE_WORDS = (
    r"address(?:\s+(?:is|was|of))?,?|branch at|check to|went to|(?:live|lived|lives|living|reside|resides|residing|stay|staying|located|home|house) at|mov(?:ed|ing) (?:to|from)|mailed to|sent? it to|delivered to"
)
#: A number and a word without a street type.
_ADDRESS_BARE = re.compile(rf"{_HOUSE},?\s+(?:{_DIR}\s+)?([^\W\d_][^\W\d_'’]{{2,}})")
#: Words before an address, and words before a count of something.
_ADDRESS_YES = ("address", "address is", "address was", "address of", " at", " to", " from", " near", " on", "address,")
_ADDRESS_NO = (" about", " for", " another", " after", " than", " of", " least", " some", " every", " within")
_ADDRESS_AFTER = re.compile(r"\s*(?:[,.;|\n)]|\Z|(?:apt|apartment|unit|suite|ste|floor)\b|(?:in|was|is|and|for|since|turned|which|where)\b)")
#: Street types that are ordinary words as well.
_VAGUE_TYPE = re.compile(r"\b(?:way|place|row|run|walk|path|hill|point|close|bend|ridge|crossing|alley|loop|trail|pike|cove|mews|court|square|circle|drive|terrace)\.?\Z")
#: Endings of street names that hold their type.
_COMPOUND = ("gate", "side", "field", "wood", "croft", "dale", "ford", "mead", "fold", "wick", "holme", "view", "land")
#: Words that a street name does not hold.
_NOT_STREET = frozenset(
    "at of in on for to from the a an and or my our their his her with by times days weeks months hours minutes years dollars miles checks "
    "business each every was were is are i we they it that this within after before until another copies bank called later ago".split()
)

# ---- person names
_TOK = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:-(?:[^\W\d_]['’])?[^\W\d_]{2,})*"
_NEXT_PART = re.compile(rf"[ \t]+({_TOK})")
_PART_BEFORE = re.compile(rf"({_TOK})((?:[ \t]+[^\W\d_]\.)*[ \t]+)\Z")
#: Particles inside names.
_PARTICLE = frozenset("de del der den di da do dos das la las los le van von bin ibn al el st y".split())
_PARTICLES = rf"(?:\s+(?:{'|'.join(sorted(_PARTICLE))})(?=\s))*"
_PERSON_AT = re.compile(rf"{_TOK}(?:\s+[^\W\d_]\.)*{_PARTICLES}\s+{_TOK}|{_TOK},\s+{_TOK}(?:\s+[^\W\d_]\.)*")
#: What may stand before a name, from its first trigger word on.
_LEFT_AT = re.compile(
    r"(?:(?:profile|account|card)\s+as|wife|husband|partner|attorney|lawyer|daughter|son|mother|father|sister|brother|friend|cousin|uncle|aunt|name\s+(?:is|was)|made\s+out\s+to"
    r"|(?:spoke|speak|speaking|talked|talking)\s+(?:with|to)|(?:the\s)?(?:agent|clerk|teller|supervisor|manager|representative|officer|banker),?|named|called|behalf\s+of|signed\s+by|payable\s+to"
    r"|(?:mr|ms|mrs|dr|miss|prof)\b\.?),?\s+"
)
#: Of these, what names things and roles as well as persons.
_LOOSE_LEFT = re.compile(r"(?:the\s)?(?:agent|clerk|teller|supervisor|manager|representative|officer|banker)\s|called|profile|account|card")
_CLOSING_AT = re.compile(
    r"(?:signed|thank\s+you|thanks|sincerely|regards|respectfully|yours\s+truly|yours|cordially|best)\s*,?\s*[\n|]\s*"
)
_TITLE = re.compile(r"(?:mr|ms|mrs|dr|miss|prof)\.?\s+")
_TOLD = re.compile(r"\s+(?:told|asked|called|promised|informed)\s+(?:me|us|my)\s")
_TOLD_NAME = re.compile(rf"(?:\A|[.!?\n|>)\w]\s+|[.!?\n|]|[-–]\s)({_PERSON_AT.pattern})\Z")
#: Trigger words, each a part of what is looked for where one stands.
_TRIGGERS = (
    [(w, "left") for w in (
        "profile", "account", "card", "wife", "husband", "partner", "attorney", "lawyer", "daughter", "son", "mother", "father", "sister", "brother", "friend",
        "cousin", "uncle", "aunt", "name", "made", "spoke", "speak", "talk", "agent", "clerk", "teller", "supervisor", "manager", "representative", "officer",
        "banker", "called", "behalf", "signed", "payable", "mr", "ms", "dr", "miss", "prof")]
    + [(w, "closing") for w in ("signed", "thank", "sincerely", "regards", "respectfully", "yours", "cordially", "best")]
    + [(w, "told") for w in ("told", "asked", "called", "promised", "informed")]
    + [(w, "name_of_id") for w in ("ssn", "s.s.n", "social", "tax", "itin", "passport", "licen", "driv", "state", "identity")]
    + [(w, "email") for w in ("@", "(at)", "( at )", "[at]", "[ at ]", "{at}", "{ at }", "dot")]
    + [(w, "digit") for w in _DIGITS.split("|")]
    + [(w, "street") for w in ("address", "branch at", "check to", "went to", "live", "living", "resid", "stay", "located", "home", "house", "moved", "moving",
        "mailed to", "sen", "delivered", "\n", "|")]
)


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    by: dict[str, list[str]] = {}
    for word, what in _TRIGGERS + _NUMBER_KIND:
        by.setdefault(word, []).append(what)
    for word, whats in by.items():
        out.add_word(word, (len(word), tuple(whats)))
    out.make_automaton()
    return out


_FIND = _automaton()
_SAYS = frozenset(kind for _, kind in _NUMBER_KIND)
#: Function words, verbs and prepositions that may follow a name, and end a clause with it.
_NAME_AFTER = re.compile(
    r"\s*(?:[,.;:!?)|\n]|\Z)|\s+(?:and|or|but|who|whom|said|says|told|asked|called|wrote|was|is|has|had|did|does|from|at|in|on|by|for|to|with|through|over|about|never|then|when|because|since|after|before|as|paid|gave|took|made|sent)\b"
)
#: Words of companies, shops, streets and towns.
_COMPANY = re.compile(
    r"\s*(?:&|bank|bancorp|financial|savings|trust|credit|federal|payments|wallet|services?|remit|inc\b|llc\b|corp|company|group|union|department|insurance|mortgage|capital|goods|supply|supplies|parts|travel"
    r"|street|avenue|road|lane|drive|ave\b|st\b|plaza|park|county|city|store|shop|mall)"
)
_PLACE_BEFORE = re.compile(r"(?:\b(?:in|near|at|port|east|west|north|south|new|fort|mount|lake|\d+)\s+)\Z")
#: Ordinary words that are no part of a name.
_NOT_NAME = frozenset(
    "a an the and or but of in on at to for from by with without my our your his her their its this that these those i we they he she it me us him them who whom which what when where why how "
    "someone somebody nobody anyone everyone no not nor is was are were be been being am has have had having do does did will would can could may might must shall should "
    "said says say told tell asked ask called call also gave give up lost all both felt went took made make got get kept keep paid sent wrote saw back again another every each any some such only still then "
    "than so just since never ever even very here there now about after before until while because if as into over under out off more most other own same too "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "agent agents manager managers supervisor clerk teller trainee desk team unit office officer branch bank banks banker banking chat claims claim dispute disputes fraud customer service services representative merchant "
    "company institution account accounts card cards check checks credit debit union financial savings trust national federal payment payments wallet inc llc corp group department resolution retention escalation "
    "landlord tenant neighbour neighbor roommate bookkeeper employer upstairs late father mother son daughter niece nephew wife husband sister brother friend ex-spouse partner caller customer "
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
    "once twice times days weeks months years hours minutes dollars business "
    "letter notice message dear sir madam please thank thanks you sincerely regards signed yours street avenue road port east west north south second first third assistant overnight drive-up".split()
)

_MASKED = re.compile(r"x{3,}|\bxx\b")
_PLAIN = re.compile(r"[^a-z0-9]+")


def plain(value: str) -> str:
    """Lower-cased with all but a-z and 0-9 removed."""
    return _PLAIN.sub("", value.lower())


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes and not no else "-" if no else "0"


class Gazetteer:
    """Name parts by kind; entries are trimmed and compared without regard to letter case."""

    def __init__(self, rows: list[tuple[str | None, str | None]]) -> None:
        by: dict[str, set[str]] = {"given": set(), "family": set(), "not_name": set()}
        for name, kind in rows:
            if name and name.strip() and kind in by:
                by[kind].add(name.strip().lower())
        self.given, self.family = by["given"], by["family"]
        self.listed = by["not_name"]
        self.names = self.given | self.family
        self._find: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}

    def parts(self, name: str) -> list[str]:
        return [p for p in re.split(r"[\s,]+", name.lower()) if len(p.rstrip(".")) > 1]

    def known(self, part: str) -> bool:
        return part in self.names or any(p in self.names for p in re.split(r"[-'’]", part) if len(p) > 2)

    def ordinary(self, part: str) -> bool:
        return part in _NOT_NAME or (part in self.listed and part not in self.names)

    def places(self, t: str) -> Iterator[tuple[int, int]]:
        """Where name parts stand as whole words."""
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for n in self.names:
                self._find.add_word(n, len(n))
            self._find.make_automaton()
        if not self.names:
            return
        for end, size in self._find.iter(t):
            a, b = end + 1 - size, end + 1
            if not (a and t[a - 1].isalnum()) and not (b < len(t) and t[b].isalnum()):
                yield a, b


def _nearest(pattern: re.Pattern, t: str, at: int, reach: int) -> str | None:
    """The name of the group of the last match before ``at``."""
    last = None
    for m in pattern.finditer(t, max(0, at - reach), at):
        last = m.lastgroup
    return last


class NumberWords:
    """Words that say what a number is, in the order of their ends."""

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.kinds: list[tuple[int, str]] = []

    def add(self, begin: int, end: int, kind: str) -> None:
        self.ends.append(end)
        self.kinds.append((begin, kind))

    def before(self, at: int, reach: int) -> str | None:
        """What the last of them before ``at``, at most ``reach`` characters away, says."""
        i = bisect_right(self.ends, at) - 1
        return self.kinds[i][1] if i >= 0 and self.kinds[i][0] >= at - reach else None


def _emails(t: str) -> Iterator[tuple[int, int, str]]:
    """Votes: signs, host, local part, words before, masks."""
    at = 0
    while m := _EMAIL.search(t, at):
        v = m.group()
        if m.end() > m.start() and v.split()[0] in _NOT_NAME:  # "write to me at …": the address begins further on
            at = m.start() + len(v.split()[0])
            continue
        at = m.end()
        local = plain(re.split(r"@|\bat\b", v)[0])
        near = _nearest(_EMAIL_BEFORE, t, m.start(), 40)
        ending = re.split(r"[^a-z]+", v)[-1]
        yield m.start(), m.end(), (
            _vote("@" in v or "(" in v or "[" in v or "{" in v) + _vote(ending in _ENDINGS) + _vote(len(local) > 3, len(local) < 2)
            + _vote(near == "yes", near == "no") + _vote(False, bool(_MASKED.search(v)))
        )


def _phones(t: str, chunks: list[tuple[int, int]], spelled: bool, said: NumberWords) -> Iterator[tuple[int, int, str]]:
    """Votes: form, number plan, words before, what follows, number of digits."""

    def around(a: int, b: int) -> str:
        near = said.before(a, 40)
        after = bool(_EXTENSION.match(t, b) or _CLAUSE_END.match(t, b))
        return _vote(near == "phone", near in ("id", "other")) + _vote(after, bool(_AMOUNT_AFTER.match(t, b)))

    for lo, hi in chunks:
        spans = [m.span() for m in _PHONE.finditer(t, lo, min(len(t), hi + 2))]
        formed = bool(spans)
        if not spans and (m := _ANY_DIGITS.search(t, lo, hi)):
            spans = [m.span()]
        for a, b in spans:
            v = t[a:b]
            digits = re.sub(r"\D", "", v)
            core = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
            plus = v.startswith("+")
            valid = (len(core) == 10 and core[0] in "23456789") or (plus and formed)
            if len(digits) > 6:
                yield a, b, _vote(formed and not v.isdigit(), not formed) + _vote(valid, not valid) + around(a, b) + _vote(len(core) == 10 or plus, len(core) not in (7, 10) and not plus)
    if spelled:
        for m in _SPELLED.finditer(t):
            count = len(re.findall(_DIGITS, m.group()))
            ok = count in (7, 10, 11)
            yield m.start(), m.end(), _vote(ok, not ok) + "0" + around(*m.span()) + _vote(ok, not ok)


#: The digits of a stretch and the signs between them.
_ANY_DIGITS = re.compile(r"\d[\d().+ \-–—/]*\d")
_LAST_DIGITS = re.compile(r"(?:last\s+(?:four|4)|ending\s+in|ends\s+in)[^.\n]{0,16}\Z")


def _ids(t: str, named: list[int], chunks: list[tuple[int, int]], words: NumberWords) -> Iterator[tuple[int, int, str]]:
    """Votes: a word of identity just before, form, nearest number word, masks and last digits, grouping."""

    def votes(a: int, b: int, said: bool) -> str:
        v = t[a:b]
        shape, near = plain(v), words.before(a, 48)
        grouped = re.sub(r"\s*[-.]\s*|\s+", "-", v)
        ssn = bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", grouped))
        return (
            _vote(said, not said and not ssn) + _vote(bool(_ID_SHAPE.fullmatch(shape)), len(shape) < 7 or len(shape) > 13) + _vote(near == "id", near != "id" and not ssn or near in ("phone", "other"))
            + _vote(False, bool(_MASKED.search(v) or _LAST_DIGITS.search(t, max(0, a - 40), a)))
            + _vote(ssn, bool(re.search(r"[/()+]", v) or re.fullmatch(r"\d{3}-\d{3}-\d{4}|\d{4}(?:-\d{4})+", grouped)))
        )

    seen: list[tuple[int, int]] = []
    for at in named:
        m = _ID.match(t, at)
        if not m or any(x <= m.start(1) < y for x, y in seen):
            continue
        a = m.start(1)
        v = re.match(r"(?:[a-z]{1,2}[ -]?)?\d[\d\s.-]*\d", m.group(1))
        if v:
            seen.append((a, a + v.end()))
            yield a, a + v.end(), votes(a, a + v.end(), True)
    for lo, hi in chunks:
        spans = [m.span() for m in _BARE_SSN.finditer(t, lo, min(len(t), hi + 2))]
        if not spans and (m := _ANY_DIGITS.search(t, lo, hi)):
            spans = [m.span()]
        for a, b in spans:
            if not any(a < y and x < b for x, y in seen) and sum(map(str.isdigit, t[a:b])) > 6:
                yield a, b, votes(a, b, False)


#: Signs (and letters) after which a number is part of something else.
_JOINED = frozenset("$./:#-–_+abcdefghijklmnopqrstuvwxyz")


def _addresses(t: str, frames: list[int]) -> Iterator[tuple[int, int, str]]:
    """Votes: street type, words of the name, words before, what follows, house number."""

    def around(a: int, b: int) -> str:
        gap = t[max(0, a - 16) : a]
        before = gap.rstrip()
        yes = not before or before[-1] == "|" or "\n" in gap[len(before) :] or before.endswith(_ADDRESS_YES)
        return _vote(yes, before.endswith(_ADDRESS_NO)) + _vote(_ADDRESS_AFTER.match(t, b) is not None)

    starts = {m.start() for m in _NUMBER.finditer(t) if m.end() - m.start() < 6 and t[m.start() - 1 : m.start()] not in _JOINED}
    for f in frames:  # a house number in words is looked for only where the words before may say address
        if w := _FRAME_NUMBER.match(t, f):
            starts.add(w.start(1))
    done = -1
    for at in sorted(starts):
        if at < done:
            continue
        m = _ADDRESS.match(t, at)
        wrong = m is not None and any(w in _NOT_STREET for w in (m.group(3) or "").split())
        if m and not wrong:
            done = m.end()
            vague = not m.group(2) and _VAGUE_TYPE.search(t, at, m.end()) is not None
            yield at, m.end(), _vote(not vague) + "+" + around(at, m.end()) + _vote(t[at].isdigit())
        elif bare := _ADDRESS_BARE.match(t, at):
            word = bare.group(1)
            wrong = word in _NOT_STREET or word in _NOT_NAME or bool(re.fullmatch(_DIR, word))
            compound = word.endswith(_COMPOUND)
            yield at, bare.end(), _vote(False, not compound) + _vote(not wrong, wrong) + around(at, bare.end()) + _vote(t[at].isdigit())


def _extended(t: str, raw: str, b: int, gaz: Gazetteer, cased: bool) -> int:
    """Where a name ends whose first two parts end at ``b``: further parts that are known, or capitalised in a text with both cases."""
    while m := _NEXT_PART.match(t, b):
        part = m.group(1)
        if part in _PARTICLE:
            after = _NEXT_PART.match(t, m.end())
            if not after or gaz.ordinary(after.group(1)) or (cased and not raw[after.start(1)].isupper()):
                break
            b = after.end()
        elif (gaz.known(part) or (cased and raw[m.start(1)].isupper())) and not gaz.ordinary(part) and not _COMPANY.match(t, m.start(1)):
            if _COMPANY.match(t, m.end()):
                break
            b = m.end()
        else:
            break
    return b


def _names(t: str, raw: str, lefts: list[int], closings: list[int], told: list[int], gaz: Gazetteer, cased: bool) -> Iterator[tuple[int, int, str]]:
    """Votes: gazetteer, words before, what follows, ordinary words, letter case."""
    found: dict[int, tuple[int, str]] = {}

    def add(at: int, how: str) -> None:
        title = _TITLE.match(t, at)
        at = title.end() if title else at
        m = _PERSON_AT.match(t, at)
        if not m or len(gaz.parts(m.group())) < 2:
            return
        end = m.end()
        if "," not in m.group():
            end = _extended(t, raw, end, gaz, cased)
        found.setdefault(at, (end, "title" if title else how))

    for at in lefts:
        if m := _LEFT_AT.match(t, at):
            add(m.end(), "loose" if _LOOSE_LEFT.match(m.group()) else "left")
    for at in closings:
        if m := _CLOSING_AT.match(t, at):
            add(m.end(), "closing")
    for at in told:
        m = _TOLD.match(t, at - 1) if at else None
        got = _TOLD_NAME.search(t, max(0, at - 61), at - 1) if m else None
        if got and not any(a < at <= e + 1 for a, (e, _) in found.items()):
            found.setdefault(got.start(1), (at - 1, "told"))
    covered = -1
    for a, b in gaz.places(t):
        if a < covered:
            continue
        known_next = _NEXT_PART.match(t, b)
        before = _PART_BEFORE.search(t, max(0, a - 40), a)
        if before and not gaz.known(before.group(1)) and cased and raw[before.start(1)].isupper() and raw[a].isupper() and not gaz.ordinary(before.group(1)):
            a = before.start(1)
        elif not known_next and not (t[b : b + 1] == "," or re.match(r"\s+[^\W\d_]\.", t[b : b + 4])):
            continue
        m = _PERSON_AT.match(t, a)
        parts = [p for p in gaz.parts(m.group()) if p not in _PARTICLE] if m else []
        if len(parts) < 2 or any(gaz.ordinary(p) for p in parts):
            continue
        if "," in m.group() and not (parts[0] in gaz.family and parts[1] in gaz.given):
            continue
        if not all(gaz.known(p) for p in parts) and not (cased and all(raw[m.start() + x.start()].isupper() for x in re.finditer(_TOK, m.group()) if x.group() not in _PARTICLE)):
            continue
        end = m.end() if "," in m.group() else _extended(t, raw, m.end(), gaz, cased)
        covered = end
        if not any(x < end and a < e for x, (e, _) in found.items()):
            found.setdefault(a, (end, "listed"))
    for a, (b, how) in found.items():
        parts = [p for p in gaz.parts(t[a:b]) if p not in _PARTICLE]
        known = sum(gaz.known(p) for p in parts)
        company = bool(_COMPANY.match(t, b)) or any(_COMPANY.fullmatch(p) for p in parts)
        place = how == "listed" and bool(_PLACE_BEFORE.search(t, max(0, a - 12), a))
        # an ordinary word that is a listed name too says nothing
        odd = any(gaz.ordinary(p) and p not in gaz.names for p in parts) or bool(_MASKED.search(t, a, b))
        unsure = any(gaz.ordinary(p) for p in parts)
        small = cased and not all(raw[a + x.start()].isupper() for x in re.finditer(_TOK, t[a:b]) if x.group() not in _PARTICLE)
        follows = how in ("closing", "told") or bool(_NAME_AFTER.match(t, b))
        yield a, b, (
            _vote(known > 1, known == 0) + _vote(how not in ("listed", "loose"), place) + _vote(follows, company) + _vote(not unsure, odd) + _vote(cased and not small, small)
        )


_FRAME_NUMBER = re.compile(rf"(?:(?:{_ADDRESS_BEFORE_WORDS})\s+|[\n|]\s*)({_WORD_NUMBER})\b")


def _lower(text: str) -> str:
    """The text lower-cased sign by sign, so that every offset stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def find_spans(text: str, gaz: Gazetteer) -> list[tuple[int, int, str, str]]:
    """Candidate spans (start, end, kind, votes and features) of one text, in order; no two overlap.

    Of overlapping candidates the one with the better balance of votes stays, then the longer one; names
    inside e-mail addresses are left to the address.
    """
    t = _lower(text)
    at: dict[str, list[int]] = {"left": [], "closing": [], "told": [], "name_of_id": [], "email": [], "digit": [], "street": []}
    said = NumberWords()
    for end, (size, whats) in _FIND.iter(t):
        a = end + 1 - size
        if a and size > 1 and t[a - 1].isalpha() and t[a].isalpha():
            continue  # inside a word
        for what in whats:
            if what in _SAYS:
                said.add(a, end + 1, what)
            else:
                at[what].append(a)
    cased = t != text and not text.isupper()
    if cased:  # a text with hardly any capitals, or hardly any small letters, says nothing by them
        cased = 0.01 < sum(map(text.count, _CAPITALS)) / len(text) < 0.4
    chunks = [m.span() for m in _NUMERIC.finditer(t)]
    every: list[tuple[int, int, int, int, int, str, str]] = []
    for rank, (kind, spans) in enumerate((
        ("email", _emails(t) if at["email"] else ()),
        ("phone", _phones(t, chunks, len(at["digit"]) > 6, said)),
        ("id_number", _ids(t, at["name_of_id"], chunks, said)),
        ("street_address", _addresses(t, at["street"])),
        ("person_name", _names(t, text, at["left"], at["closing"], at["told"], gaz, cased)),
    )):
        for a, b, votes in spans:
            shape = f"{min(9, (b - a) // 4)}{min(5, t.count(" ", a, b) + 1)}{'c' if cased else 'n'}"
            every.append((votes.count("-") - votes.count("+") if rank else -9, a - b, rank, a, b, kind, f"{votes}|{shape}"))
    out: list[tuple[int, int, str, str]] = []
    used = bytearray(len(t))
    for _, _, _, a, b, kind, votes in sorted(every):
        if used.find(1, a, b) < 0:
            used[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, votes))
    return sorted(out)


def posterior(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Expectation-maximisation over counted vote patterns of one kind: pattern -> chance of a true span.

    Each labeler has, per class, a distribution over for, against and abstain; the start is the
    balance of the votes.  What the votes mean is kept by a Dirichlet prior of 12 % of the candidates'
    weight, so that a class that hardly occurs cannot take over another meaning.
    """
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    votes = np.array([["-0+".index(c) for c in k] for k in keys])
    good = np.clip(0.5 + 0.15 * (votes - 1).sum(1), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip((good * count).sum() / count.sum(), 0.1, 0.9)
        log = np.tile(np.log([1 - prior, prior]), (len(keys), 1))
        for j in range(votes.shape[1]):
            for c, w in ((0, (1 - good) * count), (1, good * count)):
                # a vote for is likelier on a true span, one against on a false one
                lean = 0.02 * count.sum() * (np.array([1.0, 1.0, 4.0]) if c else np.array([4.0, 1.0, 1.0]))
                p = np.bincount(votes[:, j], w, 3) + lean
                log[:, c] += np.log(p / p.sum())[votes[:, j]]
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return dict(zip(keys, good.tolist()))


def _design(patterns: list[str], columns: list[str] | None = None) -> tuple[np.ndarray, list[str]]:
    """One row per pattern: a bias, votes for and against of each labeler, and the span features as indicators."""
    names = [[f"{i}{c}" for i, c in enumerate(p) if c not in "0|"] for p in patterns]
    columns = columns if columns is not None else sorted({x for n in names for x in n})
    at = {c: i + 1 for i, c in enumerate(columns)}
    x = np.zeros((len(patterns), len(columns) + 1))
    x[:, 0] = 1
    for row, n in zip(x, names):
        row[[at[c] for c in n if c in at]] = 1
    return x, columns


def train_classifier(patterns: dict[str, int], target: dict[str, float], l2: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, list[str]]:
    """(logistic weights, their columns) of votes and span features, fitted to the posteriors by Newton steps."""
    keys = sorted(patterns)
    x, columns = _design(keys)
    y, w = np.array([target[k.split("|")[0]] for k in keys]), np.array([patterns[k] for k in keys], float)
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + l2 * np.r_[0, beta[1:]]
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta, columns


def accepted_patterns(counts: list[tuple[str, str, int]]) -> dict[str, dict[str, float]]:
    """kind -> pattern of votes and features -> chance, by expectation-maximisation and the trained span classifier."""
    out: dict[str, dict[str, float]] = {}
    for kind in KINDS:
        patterns = {v: n for k, v, n in counts if k == kind}
        if patterns:
            votes: dict[str, int] = {}
            for v, n in patterns.items():
                votes[v.split("|")[0]] = votes.get(v.split("|")[0], 0) + n
            beta, columns = train_classifier(patterns, posterior(votes))
            keys = sorted(patterns)
            chance = 1 / (1 + np.exp(-np.clip(_design(keys, columns)[0] @ beta, -30, 30)))
            out[kind] = dict(zip(keys, chance.tolist()))
    return out


def candidate_spans(table: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, kind, start, stop, value, votes)`` of all candidates.

    ``lexicon`` is the fixed reference list ``(name, kind)`` of a few hundred rows, read by the driver.
    """
    gaz = Gazetteer([(r["name"], r["kind"]) for r in lexicon.select("name", "kind").collect()])
    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b, kind, votes in find_spans(text, gaz):
                    at.append(i)
                    out.append((kind, a, b, plain(text[a:b]), votes))
            if out:
                cols = list(zip(*out))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    ["id", "kind", "start", "stop", "value", "votes"],
                )

    return rows.mapInArrow(run, f"id {id_type}, kind string, start int, stop int, value string, votes string")


def span_model(spans: DataFrame) -> dict[str, dict[str, float]]:
    """The trained classifier as kind -> vote pattern -> chance, from the counts of all candidates."""
    counts = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return accepted_patterns([(r["kind"], r["votes"], r["n"]) for r in counts])


def personal_information(table: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, least: float = 0.5) -> DataFrame:
    """``(id, kind, value)`` of every item found, once per id, kind and value.

    Null and blank texts have no items; repeated rows count once; other columns are ignored.
    """
    spans = materialize(candidate_spans(table, id_col, text_col, lexicon))
    model = span_model(spans)
    yes = [f"{k}|{v}" for k, by in model.items() for v, p in by.items() if p >= least]
    return spans.where(F.concat_ws("|", "kind", "votes").isin(yes)).select("id", "kind", "value").distinct()


def redacted(table: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, least: float = 0.5) -> DataFrame:
    """``(id, redacted, items)``: each item replaced by its kind's placeholder, everything else unchanged.

    A null text stays null with 0 items.
    """
    model = span_model(candidate_spans(table, id_col, text_col, lexicon))
    yes = {(k, v) for k, by in model.items() for v, p in by.items() if p >= least}
    gaz = Gazetteer([(r["name"], r["kind"]) for r in lexicon.select("name", "kind").collect()])
    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                spans = [] if text is None else [s for s in find_spans(text, gaz) if (s[2], s[3]) in yes]
                done, parts = 0, []
                for a, b, kind, _ in spans:
                    parts += [text[done:a], PLACEHOLDER[kind]]
                    done = b
                texts.append(None if text is None else "".join(parts) + text[done:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "redacted", "items"]
            )

    return rows.mapInArrow(run, f"id {id_type}, redacted string, items int")
