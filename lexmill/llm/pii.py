"""Problem 7: personal information in free text, replaced by typed placeholders that keep equal values linked.

Patterns run over a plain form of each text (width, digits, marks and invisible characters set aside) whose characters know their
places in the text. Names are learnt from the texts themselves: a given name is a word that follows lead-ins (my name is, Mr, ...)
far more often than words do in general, and a last name one whose occurrences stand, for a good part, in the last place of names.
After a lead-in a given name needs no other evidence than its own; one that is an ordinary word too counts without a lead-in only
where a last name that surer places have shown follows.

Numbers are permuted within their format by a keyed Feistel network, so that equal numbers get equal pseudonyms in every document:
what makes a number valid (a check digit, the check number of an account, the date in an identity number, the form of a telephone
number, whose prefix stays) holds for its pseudonym too, as the permutation goes on until it does. Dates become other dates. Other
values get a keyed hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from datetime import date
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.wording import _TABLE
from lexmill.session import durable

NAME_SHARE = 0.35  # of a word's occurrences that must be in a name's last place
LIFT = 6.0  # times the general share of words after lead-ins that a given name's share must be
STRONG_SHARE = 0.2  # of a last name's occurrences that must follow lead-ins or sure given names
SURE_SHARE = 0.15  # of a given name's occurrences after lead-ins, for it to be a name without one
GIVEN_SHARE = 1 / 20_000  # of the words after lead-ins that a given name must make up to be known elsewhere: at most 20,000 are
KINDS = ("EMAIL", "PHONE", "IDNUM", "ADDRESS", "NAME")
ROUNDS = 10

# What comes before names of persons.
LEADS = (
    "شكرا يا|جارنا|جارتنا|صاحبي|صاحبتي|الاستاذ|الاستاذه|المدير|المديره|خالي|عمي|اسمي|قابلت|الدكتور|الدكتوره|المهندس|السيد|السيده|ask for|this is|my boss|thanks to|"
    "my name is|merci a|mon collegue|ma collegue|demandez|je m'appelle|monsieur|madame|mr.|mrs.|ms.|dr.|mr|mrs|esmi|ismi|sa7bi|sahbi|shokran ya|shukran ya"
).split("|")
NOT_LAST = "عيني عيوني حياتي قلبي روحي عمري دنيتي العين الحياه".split()
BUSINESS = "مطعم مطاعم مخبز محل محلات كافيه مقهي مكتبه شركه صيدليه معرض فندق بقاله متجر garage restaurant boulangerie pharmacie hotel cafe share3 شارع طريق حي زقاق ش".split()
BUSINESS_AFTER = "bakery garage restaurant cafe shop store motors pharmacy hotel street st road lane ave avenue".split()
PARTICLES = "بن ابن بنت bin ben ibn bint ould"
ID_CUES = """حسابي البنكي|حساب بنكي|رقم الحساب|رقم الاقامه|رقم البطاقه|رقم الهويه|رقم الجواز|رقمي القومي|الرقم القومي|جواز سفري(?: رقم)?|جواز سفر(?: رقم)?|بطاقتي الوطنيه|هويتي|ايبان|
id card(?: no| number)?|id no|id number|national id|passport(?: no| number)?|my iban|iban|bank account|account no|carte nationale|carte d'identite|numero de passeport|passeport(?: n)?|mon compte|
hawiya bta3ti|el bata2a|el bata2a|bata2ti|raqam el hawiya|ra2am el bata2a|jawaz(?: safari)?|7esabi|kimlik(?: no)?|pasaport(?: no)?|tc no|كد ملي|شماره ملي|شماره حساب|گذرنامه|پاسپورت|شناختي كارد(?: نمبر)?|پاسپورت نمبر""".replace("\n", "")
OTHER_CUES = "رقم الطلب|رقم الشحنه|كود الخصم|عدد,?،? المشاهدات|tracking|order(?: no)?|shipment|commande n°?|colis|views|vues|code|coupon|version|invoice|facture"

_S = r"[ \t]+"
_AT, _DOT = r"(?:@| @ |\s*[\[(]\s*at\s*[\])]\s*|\s(?:at|ات)\s)", r"(?:\.| \. |\s*[\[(]\s*dot\s*[\])]\s*|\s(?:dot|دوت)\s)"
EMAIL = regex.compile(rf"(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z][a-z0-9-]*)+|(?<![\w.%+-])[a-z0-9][a-z0-9._%+-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", regex.I)
_AT_WORD = regex.compile(r"[\[( ](?:at|ات)[\]) ]", regex.I)
_URL = regex.compile(r"(?:https?://|www\.)\S+", regex.I)
LINK = regex.compile(r"(?:https?://|www\.)\S+|(?<![\w.])@\w+|#\S+", regex.I)
_SEP = r"[-./ ]?"
PHONE = regex.compile(rf"(?<![\w+./-])(?:(?:\+|00)\d{{1,3}}{_SEP}(?:\(?\d{{1,4}}\)?{_SEP}){{1,6}}\d{{1,9}}|\(0\d{{1,3}}\){_SEP}\d{{2,5}}(?:{_SEP}\d{{2,5}}){{1,3}}|0\d{{1,3}}(?:{_SEP}\d{{2,4}}){{1,5}}|0\d{{8,10}})(?![\w+]|[-./]\d)")
IDNUM = regex.compile(rf"(?:(?<!\w)(?:{ID_CUES})\s*[:#°]?\s*(?:[\p{{L}}]+\s+)?)\K(?:[A-Z]{{2}}\d{{2}}(?:[ -]?\d{{4}}){{2,7}}(?:[ -]?\d{{1,4}})?|[A-Z]{{1,3}}[ -]?\d{{5,12}}|\d[\d -]{{5,24}}\d)(?![\w])", regex.I)
IBAN = regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?\d{4}){3,7}(?:[ -]?\d{1,4})?(?!\w)")
OTHER = regex.compile(rf"(?<!\w)(?:{OTHER_CUES})\s*[:#]?\s*\K[A-Z]{{0,3}}\d[\d-]*", regex.I)

_W = r"[\p{L}\p{M}'-]+"
_AR_TYPE = r"(?:شارع|ش\.|طريق|حي|زقاق|درب|نهج|جاده|ميدان|ساحه|حاره)"
_AR_DIR = r"(?:الشرقي|الغربي|الشمالي|الجنوبي|القبلي|البحري|الاوسط|السفلي|العلوي|الجديد|القديم)"
_AR_PART = r"(?:عماره|شقه|فيلا|بنايه|الدور|دور|طابق|الطابق|باب|منزل|قطعه|زنقه|رقم|بيت|بلوك|مبني)"
_LATIN_WAY = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Crescent|Way|Drive|Dr\.?|Close|Court|Ct\.?|Place|Square|Terrace|Boulevard|Blvd\.?)"
ADDRESS = regex.compile(
    rf"(?<![\w])(?:(?:\d+{_S})?{_AR_TYPE}{_S}?(?:\d+|(?<=\s|\.){_W}(?:{_S}{_AR_DIR})?)(?:[,،]?{_S}{_AR_PART}{_S}\d+)+(?!\w)"
    rf"|\d+[,،]?{_S}{_AR_TYPE}{_S}(?:{_W}{_S}{_AR_DIR}(?!\w)|{_W})"
    rf"|(?:3omara|3emara|villa|bayt|sha2a){_S}\d+{_S}(?:share3|sharia|tari2){_S}{_W}|\d+{_S}(?:share3|sharia){_S}{_W}"
    rf"|(?:(?:Flat|Apt\.?|Apartment|Unit){_S}\d+[A-Z]?,?{_S})?\d+[A-Z]?,?{_S}(?:[A-Z]{_W}{_S}){{1,3}}{_LATIN_WAY}(?!\w)(?:,{_S}(?:Block|Flat|Apt\.?|Unit|Floor){_S}\d+\w?)?"
    rf"|(?:Imm\.?{_S}\d+,?{_S}|\d+(?:{_S}(?:bis|ter|quater))?,?{_S})(?:rue|avenue|boulevard|bd\.?|allee|impasse|place|chemin|quai){_S}(?:(?:de la|des|du|de)(?:{_S})|de l'|d')?{_W}(?:,{_S}(?:appt\.?|apt\.?){_S}\d+)?)"
)


@cache
def _plain_char(ch: str) -> str:
    c = unicodedata.category(ch)
    if c in ("Cf", "Mn", "Me") or ch in "͏ـ":
        return ""
    if c in ("Zs", "Cc"):
        return " "
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x) not in ("Mn", "Cf")).translate(_TABLE)


class _Plain(dict):
    def __missing__(self, ch: str) -> str:
        self[ch] = out = ch if " " <= ch < "\x7f" else _plain_char(ch)
        return out


_PLAIN = _Plain()


def plain(text: str) -> tuple[str, Sequence[int]]:
    """The plain form of a text and the place in the text of each of its characters."""
    parts = [_PLAIN[ch] for ch in text]
    lengths = set(map(len, parts))
    if lengths <= {1}:
        return "".join(parts), range(len(text))
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


_DIGIT = regex.compile(r"\d")
_W2 = r"[\p{L}'-]{2,}"


@cache
def _leads() -> str:
    return "|".join(regex.escape(x).replace("\\ ", r"\s+") for x in LEADS)


@cache
def _name_pattern() -> regex.Pattern:
    """A lead-in, if there is one, and up to five words; which of them are a name is decided word by word."""
    return regex.compile(rf"(?<!\w)(?:{_leads()})\s+(?P<words>(?:\p{{L}}\.{_S}?|{_W2}{_S})(?:{_W2}{_S}){{0,3}}{_W2})(?![\w@])", regex.I)


@cache
def _lead_words() -> frozenset[str]:
    return frozenset(w for x in LEADS for w in regex.split(r"\W+", x) if len(w) > 1)


_TOKEN = regex.compile(r"[\p{L}][\p{L}'-]+")
_INITIAL = regex.compile(r"\p{L}\.")
_PART = frozenset(PARTICLES.split())
_NO_PART = frozenset([*BUSINESS, *BUSINESS_AFTER, *NOT_LAST, *(x for x in LEADS if " " not in x)])
_AFTER_INITIAL = regex.compile(rf"{_S}?({_W2})(?![\w@])")
_NEXT = regex.compile(rf"{_S}({_W2})(?![\w@])")


def _whole(t: str, at: int, given: dict[str, bool]) -> list[tuple[int, str, bool]]:
    """(end, last part, weak) of what may end a name whose given name ends at ``at``.

    Further given names and particles may come between; so may a word not known as a given name, but then what follows is weak.
    """
    m = _NEXT.match(t, at)
    if m is None:
        return []
    w = m[1].lower()
    after = _NEXT.match(t, m.end())
    if w in _PART:
        if after is None or after[1].lower() in _PART:
            return []
        w, m, after = after[1].lower(), after, _NEXT.match(t, after.end())
    if len(w) < 3 or w in _NO_PART:
        return []
    ends = [(m.end(), w, False)]
    if after is not None and after[1].lower() not in _PART | _NO_PART:
        if w in given:
            ends += _whole(t, m.end(), given)
        elif len(after[1]) > 2:
            ends.append((after.end(), after[1].lower(), True))
    return ends


def _names(t: str, given: dict[str, bool]) -> list[tuple[int, int, str, str, int]]:
    """(start, end, first part, last part, evidence) of what may be a name in plain text; evidence is 2 with a lead-in and a known given name, or an initial, 1 with either, 0 where the given name is an ordinary word too."""
    low = t.lower()
    here = {w for w in _TOKEN.findall(low)}
    if not (here & given.keys() or here & _lead_words()):
        return []
    found: list[tuple[int, int, str, str, int]] = []

    def add(start: int, first: str, ends: list[tuple[int, str, bool]], evidence: int) -> None:
        for end, last, weak in ends:
            before = t[:start].split()[-1].lower().strip(":,،") if t[:start].strip() else ""
            after = t[end:].split()[0].lower().strip(".,") if t[end:].strip() else ""
            if before not in BUSINESS and after not in BUSINESS_AFTER:
                found.append((start, end, first, last, 0 if weak else evidence))

    led = set()
    for m in _name_pattern().finditer(t, overlapped=True):
        start = m.start("words")
        if start in led:
            continue
        led.add(start)
        k = _INITIAL.match(t, start)
        if k:
            n = _AFTER_INITIAL.match(t, k.end())
            if n and len(n[1]) > 2:
                add(start, k[0], [(n.end(), n[1].lower(), False)], 2)
            continue
        k = _TOKEN.match(t, start)
        if k is None:
            continue
        first = k[0].lower()
        if first in _NO_PART:
            continue
        known = first in given
        add(start, first, _whole(t, k.end(), given), 2 if known else 1)
        n = _NEXT.match(t, k.end())
        if not known and n and n[1].lower() in given:  # the last name first
            add(start, n[1].lower(), [(n.end(), first, False)], 2)
    for k in _TOKEN.finditer(t):
        first = k[0].lower()
        if first in given and k.start() not in led and (k.start() == 0 or t[k.start() - 1] not in "@.'-_"):
            add(k.start(), first, _whole(t, k.end(), given), 1 if given[first] else 0)
    return found


def spans_of(text: str | None, given: dict[str, bool]) -> list[tuple[str, int, int, str, str, int]]:
    """(kind, start, end, first part, last part, evidence) of the values in a text; names are candidates, by the ``given`` names known and whether they are sure."""
    if not text:
        return []
    t, at = plain(text)
    found: list[tuple[str, int, int, str, str, int]] = []

    def take(kind: str, pattern: regex.Pattern, s: str, keep=lambda m: True) -> str:
        for m in pattern.finditer(s):
            if m.end() > m.start() and keep(m):
                if kind:
                    found.append((kind, m.start(), m.end(), "", "", 2))
                s = s[: m.start()] + "\x01" * (m.end() - m.start()) + s[m.end() :]
        return s

    digits = lambda m: sum(c.isdigit() for c in m[0])
    t = take("", _URL, t) if "://" in t or "www" in t else t
    if "@" in t or _AT_WORD.search(t):
        t = take("EMAIL", EMAIL, t)
    if "@" in t or "#" in t:
        t = take("", LINK, t)
    if _DIGIT.search(t):
        t = take("ADDRESS", ADDRESS, t)
        t = take("", OTHER, t, lambda m: digits(m) >= 4)
        t = take("IDNUM", IDNUM, t, lambda m: digits(m) >= 6)
        t = take("IDNUM", IBAN, t)
        t = take("PHONE", PHONE, t, lambda m: 9 <= digits(m) <= 15)
    found += [("NAME", *n) for n in _names(t, given)]
    out = []
    for kind, s, e, *rest in found:
        end = at[e - 1] + 1
        while end < len(text) and unicodedata.category(text[end]) == "Mn":
            end += 1
        out.append((kind, at[s], end, *rest))
    return out


def _flat(text: Column) -> Column:
    """The plain form of words, near enough to count them, without leaving Spark."""
    pairs = [(chr(k), v) for k, v in _TABLE.items() if isinstance(v, str) and len(v) == 1] + [(c, p) for c in map(chr, range(0xC0, 0x250)) if len(p := _plain_char(c)) == 1 and p != c]
    t = F.regexp_replace(F.regexp_replace(text, r"(?![ -~ء-ي])[\p{Mn}\p{Cf}\x{640}]", ""), r"(?i)\S+@\S+|(?:https?://|www\.)\S+|[@#]\S+|\S+ ?[\[(] ?at ?[\])] ?\S+", " . ")
    return F.lower(F.translate(t, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)))


def learnt(texts: DataFrame) -> DataFrame:
    """(word, n, n_led) of a column ``text``: the occurrences of each word, and those right after a lead-in with another word following."""
    after = rf"(?<![\p{{L}}\p{{N}}_])(?:{_leads()})\s+({_W2})(?=[ \t]+[\p{{L}}])"
    t = texts.select(_flat(F.col("text")).alias("t"))
    both = F.concat(F.regexp_extract_all("t", F.lit(r"\p{L}[\p{L}'-]+"), F.lit(0)), F.transform(F.regexp_extract_all("t", F.lit(after), F.lit(1)), lambda w: F.concat(F.lit("+"), w)))
    counts = t.select(F.explode(both).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    led = F.col("w").startswith("+")
    words = counts.groupBy(F.when(led, F.expr("substr(w, 2)")).otherwise(F.col("w")).alias("word"))
    return durable(words.agg(F.sum(F.when(led, 0).otherwise(F.col("c"))).alias("n"), F.sum(F.when(led, F.col("c")).otherwise(0)).alias("n_led")).filter("n > 0"))


def given_names(words: DataFrame) -> dict[str, bool]:
    """The given names of ``learnt`` words, with whether they are sure; of proven size, as no more than 1 / GIVEN_SHARE words can have that share each."""
    n, led = words.agg(F.sum("n"), F.sum("n_led")).first()
    if not led:
        return {}
    rows = words.filter((F.col("n_led") >= max(2.0, led * GIVEN_SHARE)) & (F.col("n_led") / F.col("n") >= LIFT * led / n)).collect()
    return {r.word: r.n_led >= SURE_SHARE * r.n for r in rows}


def find(df: DataFrame, text: str = "text", ident: str = "ord") -> DataFrame:
    """(ord, kind, span_start, span_end) of the personal values of each text; places count code points.

    Null and empty texts have none; repeated rows have theirs each; whole texts are read, however long; columns besides aren't.
    """
    rows = df.select(F.col(ident).alias("ord"), F.col(text).alias("text")).filter("text is not null")
    words = learnt(rows)
    given = df.sparkSession.sparkContext.broadcast(given_names(words))

    def scan(batches):
        for b in batches:
            yield pd.DataFrame([(i, *s) for i, t in zip(b["ord"], b["text"]) for s in spans_of(t, given.value)], columns=["ord", "kind", "span_start", "span_end", "first", "last", "evidence"])

    out = durable(rows.mapInPandas(scan, "ord long, kind string, span_start int, span_end int, first string, last string, evidence int"))
    cols = ["ord", "kind", "span_start", "span_end"]
    names = out.filter("kind = 'NAME'")
    uses = names.groupBy(F.col("last").alias("word")).agg(F.count_if(F.col("evidence") > 0).alias("n_last"), F.count_if(F.col("evidence") == 0).alias("n_weak"))
    n = F.coalesce("n", F.col("n_last"))
    enough = (F.col("n_last") > 0) & (F.col("n_last") >= STRONG_SHARE * n) & (F.col("n_last") + F.col("n_weak") >= NAME_SHARE * n)
    lasts = uses.join(words, "word", "left").filter(enough).select(F.col("word").alias("last"))
    firsts = words.filter(F.col("n_led") >= SURE_SHARE / 3 * F.col("n")).select(F.col("word").alias("first"), F.lit(True).alias("led"))
    names = names.join(lasts, "last", "left_semi").join(firsts, "first", "left").filter((F.col("evidence") != 1) | F.col("led") | F.col("first").isin(list(given.value)) if given.value else F.col("evidence").isNotNull())
    before = F.max("span_end").over(Window.partitionBy("ord").orderBy("span_start", F.desc("span_end")).rowsBetween(Window.unboundedPreceding, -1))
    names = names.select(cols).distinct().withColumn("before", before).filter("before IS NULL OR span_start >= before").drop("before")  # a name within a name is a part of it
    return out.filter("kind <> 'NAME'").select(cols).unionByName(names)


def permute(digits: str, key: bytes, back: bool = False) -> str:
    """A keyed permutation of the decimal strings of one length (a Feistel network); ``back`` inverts it."""
    n = len(digits)
    if n < 2:
        return digits
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    sizes = (10**u, 10 ** (n - u))
    f = lambda r, x: int.from_bytes(blake2b(f"{n}|{r}|{x}".encode(), key=key, digest_size=16).digest())
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2 == 0:
            a = (a + (-1 if back else 1) * f(r, b)) % sizes[0]
        else:
            b = (b + (-1 if back else 1) * f(r, a)) % sizes[1]
    return f"{a:0{u}d}{b:0{n - u}d}"


# Country codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def check_digit_holds(digits: str) -> bool:
    """Whether the last digit is the check digit of the others, every second one doubled."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def account_holds(value: str) -> bool:
    """Whether the check number of an international account number is right."""
    v = "".join(c for c in value.upper() if c.isalnum())
    return len(v) > 4 and v[:2].isalpha() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def birth_date_holds(digits: str) -> bool:
    """Whether an identity number of 14 digits begins with a century and a date."""
    if len(digits) != 14 or digits[0] not in "23":
        return False
    try:
        date(1700 + 100 * int(digits[0]) + int(digits[1:3]), int(digits[3:5]), int(digits[5:7]))
    except ValueError:
        return False
    return True


def validity(kind: str, flat: str) -> tuple:
    """What is valid about a number in its format: a pseudonym has the same."""
    digits = "".join(c for c in flat if c.isdigit())
    if kind == "PHONE":
        return (bool(PHONE.fullmatch(flat)),)
    return (flat[:2].isalpha() and account_holds(flat), not flat[:1].isalpha() and 13 <= len(digits) <= 19 and check_digit_holds(digits), birth_date_holds(digits))


def _kept(kind: str, flat: str) -> int:
    """How many leading digits of a number stay: the country's or the network's prefix, or the century of an identity number."""
    digits = "".join(c for c in flat if c.isdigit())
    if kind != "PHONE":
        return 1 if birth_date_holds(digits) else 0
    if flat.startswith(("+", "00")):
        zeros = 0 if flat.startswith("+") else 2
        return zeros + next((n for n in (1, 2) if digits[zeros : zeros + n] in SHORT_CODES), 3)
    return min(3, len(digits) - 4)


def number_pseudonym(kind: str, flat: str, key: bytes) -> str:
    """Another number of the same format, prefix and validity; one number has one, and no other number has the same."""
    digits = "".join(c for c in flat if c.isdigit())
    kept, want = _kept(kind, flat), validity(kind, flat)
    head, tail = digits[:kept], digits[kept:]
    while True:
        tail = permute(tail, key + f"{kind}{head}".encode()[: 64 - len(key)])
        new = iter(head + tail)
        out = "".join(next(new) if c.isdigit() else c for c in flat)
        if validity(kind, out) == want and _kept(kind, out) == kept:
            return out


DATE = regex.compile(r"(?<![\w/.-])(?:(?P<y>(?:19|20)\d\d)(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>(?:19|20)\d\d))(?![\w/-]|\.\d)")
_FIRST, _DAYS = date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099


def date_pseudonym(flat: str, key: bytes) -> str:
    """Another date in the same format; what isn't a date stays as it is."""
    m = DATE.fullmatch(flat)
    try:
        day = date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"])).toordinal() - _FIRST
    except (TypeError, ValueError):
        return flat
    while True:
        day = int(permute(f"{day:05d}", key))
        if day < _DAYS:
            break
    new = date.fromordinal(day + _FIRST)
    s = m["s"] or m["s2"]
    wide = 2 if len(m["m"] or m["m2"]) == 2 else 1
    part = [f"{new.month:0{wide}d}", f"{new.day:0{wide}d}"]
    return s.join([str(new.year), *part]) if m["y"] else s.join([*part[::-1], str(new.year)])


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The placeholder of a value: its kind with another number or date in the value's format, or with a keyed hash of 80 bits of its plain form."""
    flat = plain(value)[0]
    if kind in ("PHONE", "IDNUM"):
        return f"[{kind} {number_pseudonym(kind, flat, key)}]"
    if kind == "DATE":
        return f"[{kind} {date_pseudonym(flat, key)}]"
    return f"[{kind} {blake2b(' '.join(flat.lower().split()).encode(), key=key, digest_size=10).hexdigest()}]"


def masked(df: DataFrame, key: str, text: str = "text", ident: str = "ord", dates: bool = False) -> DataFrame:
    """(ord, text, n_values): each text with a typed placeholder for every value; null texts stay null. ``ident`` is unique.

    With ``dates``, whole dates count as values too. ``key`` has 32 bytes at most and is to be kept as a secret.
    """
    spans = find(df, text, ident).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "kind"))).alias("spans"))
    rows = df.select(F.col(ident).alias("ord"), F.col(text).alias("text")).join(spans, "ord", "left")
    secret = key.encode()[:32]

    def places(t: str, spans) -> list[tuple[int, int, str]]:
        out = [] if spans is None else [(s["span_start"], s["span_end"], s["kind"]) for s in spans]
        if dates:
            p, at = plain(t)
            new = [(at[m.start()], at[m.end() - 1] + 1, "DATE") for m in DATE.finditer(p)]
            out += [d for d in new if not any(d[0] < e and s < d[1] for s, e, _ in out)]
        return sorted(out)

    def replace(batches):
        for b in batches:
            texts, counts = [], []
            for t, spans in zip(b["text"], b["spans"]):
                n = 0
                if t is not None:
                    for s, e, kind in reversed(places(t, spans)):
                        t, n = t[:s] + pseudonym(kind, t[s:e], secret) + t[e:], n + 1
                texts.append(t)
                counts.append(n)
            yield pd.DataFrame({"ord": b["ord"], "text": texts, "n_values": np.array(counts, dtype=np.int32)})

    return rows.mapInPandas(replace, "ord long, text string, n_values int")
