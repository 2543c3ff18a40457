"""Personal information in free text: found, and replaced by typed placeholders.

That a term reveals a protected entity is learnt from the corpus, for all five kinds. Spans that may be one are proposed by their
outer form. Some show by themselves what they are: a mail address with its sign, a number with a country's prefix or a bracketed area code,
a number after the word for an identity document, a house number at a word for a street, a name after a title. Around and in all spans stand
terms: the one or two words before (the cue), the number's shape, the top-level domain, the town's words, the name's words. Over all
documents it is counted how often each term occurs and how often together with a span that shows itself. The share, and
the pointwise mutual information of term and protected entity, are the term's disclosure. A span that does not show itself is
protected if a term of it passes the thresholds; a name, if both of its words do. Names take one more step: cues
that mostly stand before pairs of revealing words reveal the words that follow them. No lead-in, domain or town is listed.

Disclosing terms are sent to the workers as 64-bit hashes while there are at most MAX_TERMS; beyond that as a bit map, and what it lets pass is
joined with the exact terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut, spread

#: A revealing word's share of occurrences in names, and its mutual information with them in bits; the same share of cues, domains and towns, and of shapes.
MIN_SHARE, MIN_BITS, CUE_SHARE, SHAPE_SHARE = 0.15, 4.0, 0.3, 0.8
#: Revealing terms sent as exact hashes (8 bytes each), and the size of the bit map beyond.
MAX_TERMS, MAP_BITS = 1 << 22, 26
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_GAP = r"[ \t\u00a0\u202f]"
#: Titles of persons, in three languages.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "herr", "herrn", "frau", "г-н", "г-жа", "господин", "госпожа")
#: The words for a name and a signature, which show that one follows.
NAME_WORDS = ("name", "names", "namens", "имя", "имени", "signed", "signature", "gezeichnet", "unterschrift", "подпись")
#: The words that spell out the signs of a mail address.
_AT, _DOT = r"(?:at|ät|собака)", r"(?:dot|punkt|точка)"
#: Words for identity documents, insurance and tax numbers.
ID_WORDS = (
    "passport", "identity card", "id card", "insurance", "social security", "tax", "driving licen", "паспорт", "снилс", "инн", "удостоверени", "полис", "ausweis", "reisepass", "pass", "versicherung", "steuer", "id",
    "nino", "ssn", "vat",
)
#: Street words.
_EN_STREET = r"(?:street|st|road|rd|lane|ln|row|avenue|ave|close|drive|square|sq|way|court|place|terrace|crescent|boulevard|blvd)"
_DE_STREET = r"(?:straße|strasse|str|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee)"
_RU_STREET = r"(?:ул\.|улица|пр-т|проспект|пер\.|переулок|ш\.|шоссе|наб\.|набережная|б-р|бульвар|пл\.|площадь)"
_MAIL_HINTS = ("@", "＠", "(at", "[at", "{at", "(ät", "[ät", "{ät", "собака", " dot ", " точка ", " punkt ")


@lru_cache(maxsize=1)
def _patterns() -> dict[str, object]:
    import regex

    i = regex.IGNORECASE
    at = rf"(?:[@＠]|{_GAP}[@＠]{_GAP}|{_GAP}?[\[({{]{_AT}[\])}}]{_GAP}?)"
    dot = rf"(?:\.|{_GAP}?[\[({{]{_DOT}[\])}}]{_GAP}?)"
    local = r"[\p{L}\d](?:[\p{L}\d._%+\-]*[\p{L}\d_\-])?"
    label = r"[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?"
    top = r"(?<top>\p{L}{2,24}|xn--[a-z0-9\-]+)"
    edge, end = r"(?<![\p{L}\d.+_%\-])", r"(?![\p{L}\d_]|[\-][\p{L}\d])"
    spelt = rf"{local}{_GAP}{_AT}{_GAP}{label}(?:\.{label})*(?:{_GAP}{_DOT}{_GAP}{label}(?:\.{label})*)*{_GAP}{_DOT}{_GAP}{top}"

    s = r"[ \u00a0\u202f.\-/]"
    tail = rf"(?:,?{_GAP}?(?:ext|extension|x|доб|dw|durchwahl)\.?{_GAP}?\d{{1,5}})?"
    before, after = r"(?<![\p{L}\d+/.\-]|\d )", r"(?![\d]|[\-/]\d|[.,:]\d|\p{L})"
    shown = rf"(?:(?:\+|00)(?:[1-9]\d{{0,2}}){s}?(?:\(\d{{1,5}}\){s}?)?\d{{1,5}}(?:{s}?\d{{1,5}}){{1,5}}|[87]{s}?\(\d{{3,5}}\){s}?\d{{1,3}}(?:{s}?\d{{2,4}}){{1,3}}|\(0?\d{{2,4}}\){s}?\d{{3,5}}(?:{s}?\d{{2,5}}){{1,2}})"
    plain = (
        rf"(?:8[ \u00a0\u202f\-]\d{{3}}[ \u00a0\u202f\-]\d{{3}}[ \u00a0\u202f\-]?\d{{2}}[ \u00a0\u202f\-]?\d{{2}}|8\d{{10}}"
        rf"|0[1-9]\d{{1,4}}{s}\d{{3,5}}(?:{s}?\d{{2,5}}){{0,2}}|07\d{{9}}|[2-9]\d{{2}}[.\- ]\d{{3}}[.\- ]\d{{4}}|\d{{2,5}}(?:{s}\d{{2,5}}){{1,4}})"
    )

    # a value: up to two letters, groups that hold digits, and a closing letter after two leading ones
    group = r"[\p{L}\d]*\d[\p{L}\d]*"
    value = rf"(?:[A-Za-zА-Яа-я]{{2}}(?:{_GAP}\d{{2}}){{3}}{_GAP}[A-Za-z](?!\p{{L}})|(?:[A-Za-zА-Яа-я]{{1,2}}{_GAP})?{group}(?:(?:{_GAP}?[\-/]{_GAP}?|{_GAP}(?:№{_GAP}?)?|№)\d[\p{{L}}\d]*)*)"
    label_ = (
        r"(?:passport|identity card|id card|insurance|social security|national insurance|tax|taxpayer|driving licen[cs]e|паспорт\w*|снилс|инн|удостоверени\w*|полис\w*|"
        r"(?:personal)?ausweis|reisepass|pass|versicherungs\w*|sozialversicherungs\w*|steuer\w*|steuer-?id|id|nino|ssn|vat)"
    )
    between = rf"(?:{_GAP}*(?:number|no|nr|nummer|id|номер|серия|card|#|№)\b?\.?)*[:\s]*"
    ident = rf"(?<![\p{{L}}\d_\-]){label_}(?![\p{{L}}_])(?:\.)?{between}\s*(?<value>{value})(?![\p{{L}}\d])"

    sep = r"(?:,\s*|\s*\n\s*|[ \u00a0]+)"
    cap = r"\p{Lu}[\p{L}\p{M}'’\-]+"
    any_ = r"\p{L}[\p{L}\-]+"
    town = lambda w: rf"{w}(?:[ \u00a0]{w})?"
    # a town starts with a capital; in a text of one case it may be any words, and those that reveal no town are cut off again
    en = lambda word, t: rf"(?<![\p{{L}}\d\-.,:=])(?:(?i:flat|apartment|apt\.?|unit|suite)\s+\d+\w?{sep})?\d{{1,4}}[A-Za-z]?\s+(?:{word}\s+){{1,3}}?(?i:{_EN_STREET})\b\.?(?:,\s*{t}(?:,?\s+\d{{5}}\b)?|\s+{t}\s+\d{{5}}\b|,?\s+\d{{5}}\b)?"
    street_de = rf"(?:[\p{{L}}\-]+(?i:{_DE_STREET})|(?:\p{{L}}[\p{{L}}\-]+[ \u00a0])+(?i:{_DE_STREET}))(?:\.|\b)\s*\d{{1,4}}(?:[ \u00a0]?[a-zA-Z])?(?!\p{{L}}|\d)"
    town_de = r"\p{L}[\p{L}\-]+(?:[ \u00a0](?:am|an der|im|bei|ob der)[ \u00a0]\p{Lu}[\p{L}\-]+)?"
    de = rf"(?<![\p{{L}}\d\-])(?:\d{{5}}\s+{town_de},?\s+)?{street_de}(?:,\s*(?:\d{{5}}\s+)?{town_de}|\s+\d{{5}}\s+{town_de})?"
    ru_street = rf"(?:(?i:{_RU_STREET})\s*(?:{any_})(?:[ \u00a0]\p{{Lu}}[\p{{L}}\-]+)?|{any_}\s+(?i:{_RU_STREET}))"
    ru_house = r"(?:,\s*|\s+)(?:(?i:д\.|дом|д)\s*)?\d{1,4}(?:[ \u00a0]?(?i:к|корп\.?|стр\.?)[ \u00a0]?\d+|[а-яА-Я](?!\p{L}))?(?:,\s*(?i:кв\.|квартира|оф\.)\s*\d+)?"
    ru = rf"(?<![\p{{L}}\d\-])(?:\d{{6}},?\s+)?(?:(?i:г\.|город)\s*{town(any_)},?\s+|{town(cap)},\s+)?{ru_street}{ru_house}(?:,\s*(?:(?i:г\.)\s*{town(any_)}|\d{{6}}))*(?!\d)"
    return {
        "email": regex.compile(rf"{edge}{local}{at}{label}(?:{dot}{label})*{dot}{top}{end}", i),
        "at": regex.compile(rf"[@＠]|[\[({{]{_AT}[\])}}]", i),
        "spelt": regex.compile(rf"{edge}{spelt}{end}", i),
        "spelt_at": regex.compile(rf"(?<={_GAP}){_AT}(?={_GAP}[^\s]+{_GAP}(?:{_DOT}{_GAP}|[^\s]+{_GAP}{_DOT}{_GAP}))", i),
        "phone": regex.compile(rf"{before}(?:(?<shown>{shown})|{plain}){tail}{after}", i),
        "id_number": regex.compile(ident, i),
        "ru": regex.compile(ru), "de": regex.compile(de), "en": regex.compile(en(cap, town(cap))),
        "en_lower": regex.compile(en(r"(?!(?:the|an?|this|that|to|of)\b)\p{Ll}[\p{Ll}\p{M}'’\-]+", town(any_))),
        "split": regex.compile(r"[^\p{L}]+"),
        "at_or_blank": regex.compile(r"[@＠\[({]|\s"),
    }


def _upper_class() -> str:
    """The capital letters, as the ranges of a character class."""
    points = [c for c in range(0x41, 0x2C00) if chr(c).isupper()]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip([0, *cuts], [*cuts, len(points)], strict=True))


_MARKS = "\u0300-\u036f"
_LETTER, _UP = r"[^\W\d_]", _upper_class()
_WORD = re.compile(rf"{_LETTER}[^\W\d_{_MARKS}]*(?:[{_MARKS}]|['’ʼ`\-‐‑](?={_LETTER})|{_LETTER})*")
_CAPITAL = rf"(?:[{_UP}]\.(?!{_LETTER}\.)|[{_UP}](?:[{_MARKS}]|['’ʼ`\-‐‑](?={_LETTER})|{_LETTER})*)"
#: A capitalised word and the next one, if only a blank or a comma and a blank, or after an initial nothing, is between them.
_PAIR = re.compile(rf"(?<![^\W\d_])(?<![^\W\d_]['’ʼ`\-‐‑])({_CAPITAL})(?=(?:,?{_GAP}{{1,7}}|(?<=\.))({_CAPITAL}))")
# five digits or more with signs of numbers between them, nine or more with those of a phone number
_MANY = re.compile(r"(?<![^\W_])(?:[A-Za-zА-Яа-я]{1,2}[ \u00a0]?)?\d(?:[ \-/№\u00a0\u202f]{0,3}[A-Za-z]{0,2}\d){4,}(?:[ ]?[A-Za-z])?(?!\w)")
_FIVE = re.compile(r"\d(?:[ \-/№\u00a0\u202f]{0,3}[A-Za-z]{0,2}\d){4,}")
_SIGNS = r"[() .\-/\u00a0\u202f]"
_NINE = re.compile(rf"\d(?:{_SIGNS}{{0,3}}\d){{8,}}")
_NUMBER_SET, _BLANKS = frozenset("0123456789() .-/+\u00a0\u202f"), frozenset(" \t\u00a0\u202f")
_NO_LEFT, _NO_RIGHT = frozenset("-#=№/.:"), frozenset("-/=")
_DATED = re.compile(r"(?:\d{4}-\d\d-\d\d|\d\d[.\-]\d\d[.\-]\d{4})(?: \d\d)?")
# signs of an address, looked for in the text in one spelling
_RU_HINT = re.compile(_RU_STREET)
_DE_HINT = re.compile(_DE_STREET.replace("straße|", "") + r"\.?\s*\d")
_EN_HINT = re.compile(rf"\d[a-z]?\s+(?:{_LETTER}[^\s\d,.]*\s+){{1,3}}?{_EN_STREET}\b")
_NAME = rf"[{_UP}][\w'’\-]+"
#: What stands where an address may stand: capitalised words and a house number, in either order, with a postcode or another name.
_PLACE = re.compile(
    rf"(?<![\w\-])(?:{_NAME}(?:[ \u00a0]{_NAME}){{0,3}},?[ \u00a0]\d{{1,4}}[a-zA-Z]?|\d{{1,4}}[a-zA-Z]?,?[ \u00a0]{_NAME}(?:[ \u00a0]{_NAME}){{0,3}})(?:,\s*(?:\d{{4,6}}\s+)?{_NAME}(?:[ \u00a0]{_NAME})?|,?\s+\d{{4,6}}(?:\s+{_NAME})?)(?!\w)"
)
_SHOWING = frozenset((*TITLES, *NAME_WORDS))
_DIGIT = str.maketrans(dict.fromkeys("0123456789", "9") | {"\u00a0": " ", "\u202f": " "})


def cues(text: str, start: int) -> tuple[str, ...]:
    """The two words before a place in its line or the line before, and the last of them, in one spelling; a sentence's end parts them from it."""
    before = text[max(0, start - 48) : start]
    t = before.rstrip(" \t\n\u00a0(<\"'")
    if before.count("\n", len(t)) > 1:
        return ()
    bare = t.rstrip(":,")
    words = bare[bare.rfind("\n") + 1 :].split()[-2:]
    if not words:
        return ()
    last = words[-1]
    if last[-1] == "." and len(last) <= 4:
        last = last[:-1]
    if not last.replace("-", "").isalpha():
        return ()
    last = last.casefold() + (":" if t[len(bare) :].startswith(":") else "")
    return (f"{words[0].casefold()} {last}", last) if len(words) > 1 and words[0].replace("-", "").isalpha() else (last,)


def _cased(text: str) -> bool:
    """Whether capitals tell anything: a text with letters of both cases."""
    return not (text.isupper() or text.islower())


_TOWN_END = re.compile(rf"((?:,\s*(?:\d{{5}}\s+)?|\d{{5}}\s+))({_LETTER}[\w\-]*)(?:([ \u00a0])({_LETTER}[\w\-]*))?\Z")


def _trim_towns(text: str, a: int, b: int, reveals: Callable[[str], bool]) -> int:
    """An address' end without the words after its last comma or postcode that are no part of a town: without a capital, or in a span of one case any, a word must reveal a town."""
    m = _TOWN_END.search(text[a:b])
    if m is None:
        return b
    cased = _cased(text[a:b])
    town = lambda w: (cased and w[0].isupper()) or reveals(f"t:{w.casefold()}")
    if m[4] and town(m[4]):
        return b
    if town(m[2]):
        return a + m.end(2)
    sign = m[1].rstrip()
    return a + m.start() + (len(sign) if sign[-1].isdigit() else 0)


def candidates(text: str, reveals: Callable[[str], bool] = lambda term: False) -> Iterator[tuple[int, int, str, bool, tuple[str, ...]]]:
    """(start, end, kind, whether the span shows itself, its terms) of all spans but names, kinds of higher precedence first.

    ``reveals`` only cuts words off the ends of addresses. Each kind is looked for only where a quick pattern finds a sign of it.
    """
    p, low = _patterns(), text.casefold()
    if any(h in low for h in _MAIL_HINTS):
        yield from _mail(p, text)
    # numbers after the word for a document, the rest of them later
    numbers, shown_numbers = list(_FIVE.finditer(text)), []
    words = [w for w in ID_WORDS if w in low] if numbers else ()
    end = 0
    for i, h in enumerate(numbers) if words else ():
        before = text[max(0, h.start() - 60) : h.start()].casefold()
        if any(w in before for w in words):
            stop = h.end() + 8 if i + 1 == len(numbers) else min(h.end() + 8, numbers[i + 1].start())
            for m in p["id_number"].finditer(text, max(end, h.start() - 60), stop):
                a, b = m.span("value")
                if b > a and sum(map(str.isdigit, text[a:b])) >= 5:
                    shown_numbers.append((a, b))
                    yield a, b, "id_number", True, (f"is:{_shape_of(text[a:b])}",)
                    end = b
    spans = []
    # room before and after a street word for all that belongs to its address
    for form, hint, room in (("ru", _RU_HINT, 160), ("de", _DE_HINT, 160), ("en", _EN_HINT, 80), ("en_lower", _EN_HINT, 80)):
        end = 0
        for h in hint.finditer(low):
            # places in the text of one spelling are those of the text, but for rare letters that change their length
            at = (max(end, h.start() - room), h.end() + room + 40) if len(low) == len(text) else (end, len(text))
            for m in p[form].finditer(text, *at):
                # what begins later has a hint of its own, and room
                if len(low) == len(text) and m.start() >= h.end():
                    break
                a, b = m.start(), _trim_towns(text, m.start(), m.end(), reveals)
                end = m.end()
                spans.append((a, b))
                words = tuple(f"t:{w.casefold()}" for w in _WORD.findall(text[a:b]) if w[0].isupper()) if _cased(text[a:b]) else ()
                yield a, b, "address", True, (*(f"ac:{c}" for c in cues(text, a)), *words)
    for m in _PLACE.finditer(text):
        a, b = m.span()
        if not text[a:b].isupper() and not any(x < b and a < y for x, y in spans):
            yield a, b, "address", False, tuple(f"ac:{c}" for c in cues(text, a) if " " in c or ":" in c)
    for h in _NINE.finditer(text):
        if _DATED.fullmatch(h.group()):
            continue
        # room for an extension; an end within another run of digits would cut the number that stands there
        end = h.end() + 24
        while end < len(text) and text[end].isdigit() and text[end - 1] in _NUMBER_SET:
            while end < len(text) and text[end] in _NUMBER_SET:
                end += 1
            end += 24
        for m in p["phone"].finditer(text, max(0, h.start() - 2), end):
            number = m.group()
            # digits without any sign between them are a number only with a plus or in full national length
            if 9 <= sum(map(str.isdigit, number)) <= 18 and not (number.isdigit() and len(number) < 11):
                yield m.start(), m.end(), "phone", m["shown"] is not None, (f"ps:{_shape_of(number)}", *(f"pc:{c}" for c in cues(text, m.start())))
    for h in numbers:
        m = _MANY.match(text, max(0, h.start() - 3)) or _MANY.match(text, max(0, h.start() - 2)) or _MANY.match(text, max(0, h.start() - 1)) or _MANY.match(text, h.start())
        if m:
            a, b = m.span()
            if text[a - 1 : a] not in _NO_LEFT and text[b : b + 1] not in _NO_RIGHT and not any(x < b and a < y for x, y in shown_numbers):
                yield a, b, "id_number", False, (f"is:{_shape_of(m.group())}",)


def _mail(p: dict, text: str) -> Iterator[tuple[int, int, str, bool, tuple[str, ...]]]:
    """The mail addresses; each is read from the start of the word before its sign."""

    def start(at: int) -> int:
        while at and (text[at - 1] in _BLANKS or text[at - 1] in "[({") and at > 0:
            at -= 1
        while at and (text[at - 1].isalnum() or text[at - 1] in "._%+-"):
            at -= 1
        while at < len(text) and text[at] in "._%+-":
            at += 1
        return at

    for sign, form, shown in (("at", "email", True), ("spelt_at", "spelt", False)):
        end = 0
        for h in p[sign].finditer(text):
            # a domain has 255 signs at most
            m = p[form].match(text, max(end, start(h.start())), h.end() + 300)
            if m:
                terms = (f"d:{m['top'].casefold()}",)
                yield m.start(), m.end(), "email", shown, terms if shown else (*terms, *(f"ec:{c}" for c in cues(text, m.start())))
                end = m.end()


def _shape_of(number: str) -> str:
    """A number's shape: its digits alike, one kind of blank."""
    return number.translate(_DIGIT)


def _initial(word: str) -> bool:
    return len(word) == 2 and word[1] == "."


def name_candidates(text: str, taken: bytearray) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, first term, second term) of neighbouring capitalised words that may be a name; an initial's term is empty.

    Given name, middle initial and family name are one candidate, and the halves two more. Words in ``taken`` places are none, nor is a
    single letter without a point.
    """
    pairs = [m for m in _PAIR.finditer(text) if len(m[1]) > 1 and len(m[2]) > 1 and not taken[m.start()] and not taken[m.start(2)]]
    for i, m in enumerate(pairs):
        w, v = m[1], m[2]
        s, t = _initial(w), _initial(v)
        if s and t:
            continue
        if t and i + 1 < len(pairs) and pairs[i + 1].start() == m.start(2) and not _initial(pairs[i + 1][2]):
            yield m.start(), pairs[i + 1].end(2), w.casefold(), pairs[i + 1][2].casefold()
        yield m.start(), m.end(2), "" if s else w.casefold(), "" if t else v.casefold()


def _lower_pairs(text: str, taken: bytearray, reveals: Callable[[str], bool]) -> Iterator[tuple[int, int, str, str]]:
    """As ``name_candidates``, of words in lower case that both reveal a person."""
    before = None
    for m in _WORD.finditer(text):
        w = m.group()
        if w[0].islower() and len(w) > 2 and _revealing_word(w, reveals) and not taken[m.start()]:
            if before and text[before.end() : m.start()] in (" ", "\u00a0"):
                yield before.start(), m.end(), before.group(), w
            before = m
        else:
            before = None


_COUNTS = "kind string, a string, b string, w string, v string, n bigint, p bigint"


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``_COUNTS``: ``term`` (a term, its occurrences, those with a protected entity), ``pair`` (two cues, two words, their occurrences)."""
    p = _patterns()
    for f in frames:
        n: Counter = Counter()
        words: Counter = Counter()
        own: Counter = Counter()
        pairs: Counter = Counter()
        for text in f["text"]:
            if not text:
                continue
            words.update(_WORD.findall(text.casefold()))
            taken = bytearray(len(text) + 1)
            for a, b, kind, shown, terms in candidates(text):
                n.update(terms)
                if shown:
                    own.update(terms)
                    taken[a:b] = b"\1" * (b - a)
                    if kind == "email":
                        local = p["split"].split(p["at_or_blank"].split(text[a:b])[0].casefold())
                        own.update("n:" + w for w in local if len(w) > 3)
            for a, _, w, v in name_candidates(text, taken):
                c = cues(text, a)
                if c and c[-1].rstrip(":") in _SHOWING:
                    own.update("n:" + x for x in (w, v) if x)
                elif w != v:
                    pairs[(c[0] if len(c) > 1 else "", c[-1] if c else "", w, v)] += 1
        n.update({f"n:{w}": k for w, k in words.items()})
        terms = pd.DataFrame({"kind": "term", "a": list(n), "b": "", "w": "", "v": "", "n": list(n.values()), "p": [own[t] for t in n]})
        of = list(zip(*pairs, strict=True)) or [()] * 4
        yield pd.concat([terms, pd.DataFrame({"kind": "pair", "a": of[0], "b": of[1], "w": of[2], "v": of[3], "n": list(pairs.values()), "p": 0})])


def _share(p, n):
    return (p + 0.1) / (n + 0.5)


def term_disclosure(docs: DataFrame, text: str) -> DataFrame:
    """(term, n, p, share, bits) of every term of all texts: occurrences, those that reveal a protected entity, their share, mutual information in bits.

    Terms are ``n:`` words of names, ``t:`` of towns, ``d:`` top-level domains, ``ps:`` and ``is:`` shapes of phone and identity numbers, and
    ``pc:``, ``ac:``, ``ec:`` and ``nc:`` cues before phone numbers, addresses, mail addresses and names.
    """
    counted = docs.select(F.col(text).alias("text")).mapInPandas(_counts, _COUNTS)
    counted = cut(counted.groupBy("kind", "a", "b", "w", "v").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    terms = counted.where("kind = 'term'").select(F.col("a").alias("term"), "n", "p")
    pairs = counted.where("kind = 'pair'").select("a", "b", F.concat(F.lit("n:"), "w").alias("w"), F.concat(F.lit("n:"), "v").alias("v"), "n")
    words = terms.where(F.col("term").startswith("n:"))
    base = words.agg(((F.sum("p") + 1) / (F.sum("n") + 1)).alias("base"))
    # words that stand after titles or in mail addresses, more often than chance by MIN_BITS
    known = words.join(F.broadcast(base)).where(F.log2(_share(F.col("p"), F.col("n")) / F.col("base")) >= MIN_BITS).select("term")
    known = cut(known.unionByName(docs.sparkSession.createDataFrame([("n:",)], "term string")))
    is_known = lambda c: known.select(F.col("term").alias(c), F.lit(1).alias(f"{c}_known"))
    judged = pairs.join(is_known("w"), "w", "left").join(is_known("v"), "v", "left")
    judged = judged.withColumn("p", F.when(F.col("w_known").isNotNull() & F.col("v_known").isNotNull(), F.col("n")).otherwise(0)).select("a", "b", "w", "v", "n", "p")
    judged = cut(judged)
    cue = judged.select(F.explode(F.array("a", "b")).alias("cue"), "n", "p").where("cue <> ''").groupBy("cue").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    leads = cut(cue.where(_share(F.col("p"), F.col("n")) >= CUE_SHARE))
    lead = lambda c: leads.select(F.col("cue").alias(c), F.lit(1).alias(f"{c}_leads"))
    led = judged.join(lead("a"), "a", "left").join(lead("b"), "b", "left").where("a_leads is not null or b_leads is not null")
    more = led.select(F.explode(F.array("w", "v")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("more"))
    words = words.join(more, "term", "left").select("term", "n", (F.col("p") + F.coalesce("more", F.lit(0))).alias("p"))
    rest = terms.where(~F.col("term").startswith("n:"))
    # a town's word is judged by all its occurrences, as a name's is
    towns = rest.where(F.col("term").startswith("t:")).select("term", "p").join(words.select(F.concat(F.lit("t:"), F.substring("term", 3, 1 << 30)).alias("term"), "n"), "term").select("term", F.greatest("n", "p").alias("n"), "p")
    other = rest.where(~F.col("term").startswith("t:"))
    found = words.unionByName(towns).unionByName(other).unionByName(leads.select(F.concat(F.lit("nc:"), "cue").alias("term"), "n", "p"))
    share = _share(F.col("p"), F.col("n"))
    return found.join(F.broadcast(base)).select("term", "n", "p", share.alias("share"), F.log2(share / F.col("base")).alias("bits"))


def revealing_terms(disclosure: DataFrame) -> DataFrame:
    """(term): those whose disclosure passes the thresholds of their kind."""
    kind = F.substring_index("term", ":", 1)
    least = F.when(kind == "n", MIN_SHARE).when(kind.isin("ps", "is"), SHAPE_SHARE).otherwise(CUE_SHARE)
    return disclosure.where((F.col("share") >= least) & (F.col("bits") >= F.when(kind == "n", MIN_BITS).otherwise(F.lit(0.0)))).select("term")


class _Reveals:
    """Whether a term is revealing, by sorted hashes or by a bit map; answers are remembered, a bounded number of them."""

    def __init__(self, exact: bool, raw: bytes):
        self.exact, self.known = exact, {"n:": True}
        self.at = np.frombuffer(raw, np.int64) if exact else np.frombuffer(raw, np.uint8)

    def __call__(self, term: str) -> bool:
        got = self.known.get(term)
        if got is None:
            import xxhash

            h = xxhash.xxh64_intdigest(term.encode(), 42)
            h -= (h >> 63) << 64
            if self.exact:
                i = int(np.searchsorted(self.at, h))
                got = i < len(self.at) and self.at[i] == h
            else:
                bit = h & ((1 << MAP_BITS) - 1)
                got = bool(self.at[bit >> 3] >> (7 - (bit & 7)) & 1)
            if len(self.known) > 1 << 20:
                self.known = {"n:": True}
            self.known[term] = got
        return got


def _revealing_word(term: str, reveals: Callable[[str], bool]) -> str | None:
    """The word, or the first part of a double name, that reveals a person; None without any. An initial is judged by its neighbour."""
    return next((x for x in (term, *(term.split("-") if "-" in term else ())) if reveals(f"n:{x}")), None)


def mentions_of(text: str, reveals: Callable[[str], bool], lower_words: Callable[[str], bool] | None = None) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, the terms it rests on) of all mentions of a text, those of one kind disjoint; a name inside another kind's span is none."""
    out = []
    taken = bytearray(len(text) + 1)

    def free(a: int, b: int) -> bool:
        if a >= b or 1 in taken[a:b]:
            return False
        taken[a:b] = b"\1" * (b - a)
        return True

    for a, b, kind, shown, terms in candidates(text, reveals):
        on = [] if shown else [t for t in terms if reveals(t)]
        if (shown or on) and free(a, b):
            out.append((a, b, kind, on))
    for a, d, w, v in name_candidates(text, taken):
        w, v = _revealing_word(w, reveals), _revealing_word(v, reveals)
        # what lies within the candidate before is its part
        if w is not None and v is not None and free(a, d):
            out.append((a, d, "name", [f"n:{x}" for x in (w, v) if x]))
    if lower_words is None or lower_words(text):
        for a, d, w, v in _lower_pairs(text, taken, reveals):
            if free(a, d):
                out.append((a, d, "name", [f"n:{_revealing_word(x, reveals)}" for x in (w, v)]))
    return out


class _LowerWords:
    """Whether a text holds a revealing word in lower case at all; each word is looked up once."""

    def __init__(self, reveals: Callable[[str], bool]):
        self.reveals, self.seen, self.yes = reveals, set(), set()

    def __call__(self, text: str) -> bool:
        words = set(_WORD.findall(text))
        if new := words - self.seen:
            if len(self.seen) > 1 << 20:
                self.seen, self.yes = set(), set()
                new = words
            self.seen |= new
            self.yes |= {w for w in new if w[0].islower() and len(w) > 2 and _revealing_word(w, self.reveals)}
        return not self.yes.isdisjoint(words)


_FOUND = "doc bigint, start int, end int, kind string, found_text string, terms array<string>"


def _find(shared, exact: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reveals = _Reveals(exact, shared.value)
        lower = _LowerWords(reveals)
        for f in frames:
            out = []
            for doc, text in zip(f["doc"], f["text"], strict=True):
                if text:
                    out.extend((doc, a, b, kind, text[a:b], on) for a, b, kind, on in mentions_of(text, reveals, lower))
            yield pd.DataFrame(out, columns=["doc", "start", "end", "kind", "found_text", "terms"])

    return run


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Of spans that overlap the one that begins first is replaced, of these the longest."""
    at, parts = 0, []
    for a, b, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= at:
            parts += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join([*parts, text[at:]])


def _clean(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reveals = _Reveals(True, shared.value)
        lower = _LowerWords(reveals)
        for f in frames:
            yield f.assign(text=[t if not t else _replaced(t, [m[:3] for m in mentions_of(t, reveals, lower)]) for t in f["text"]])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")), "doc")


def _learnt(rows: DataFrame, max_terms: int) -> tuple[object, bool, DataFrame]:
    """What the workers get, whether it is exact, and the terms."""
    terms = cut(revealing_terms(term_disclosure(rows, "text")))
    sc, h = rows.sparkSession.sparkContext, F.xxhash64("term")
    if terms.count() <= max_terms:
        at = terms.select(h.alias("h")).distinct().toArrow()["h"].to_numpy()
        return sc.broadcast(np.sort(at).astype(np.int64).tobytes()), True, terms
    # at most 2**MAP_BITS positions, so what comes to the driver is bounded
    bits = np.zeros(1 << MAP_BITS, np.uint8)
    for batch in terms.select(h.bitwiseAND(F.lit((1 << MAP_BITS) - 1)).cast("int").alias("b")).distinct().toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = 1
    return sc.broadcast(np.packbits(bits).tobytes()), False, terms


def find_mentions(docs: DataFrame, doc_id: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, start, end, kind, found_text) of every mention; offsets count code points.

    Null, empty and blank texts have none. Terms are judged by all documents, each mention in its own;
    repeated documents count as often as they stand there. Other columns are ignored, so names cannot clash.
    """
    rows = _rows(docs, doc_id, text)
    shared, exact, terms = _learnt(rows, max_terms)
    found = rows.mapInPandas(_find(shared, exact), _FOUND)
    if not exact:
        found = _verified(found, terms)
    return found.select(F.col("doc").alias(doc_id), "start", "end", "kind", "found_text")


def _verified(found: DataFrame, terms: DataFrame) -> DataFrame:
    """The mentions whose terms reveal exactly as the map said: all words of a name, any term of another span; those that rest on none stay."""
    one = found.select("doc", "start", "end", "kind", "found_text", F.size("terms").alias("need"), F.explode_outer("terms").alias("term"))
    known = one.join(terms.withColumn("ok", F.lit(1)), "term", "left").groupBy("doc", "start", "end", "kind", "found_text", "need").agg(F.count("ok").alias("hit"))
    return known.where((F.col("need") <= 0) | F.when(F.col("kind") == "name", F.col("hit") >= F.col("need")).otherwise(F.col("hit") > 0))


def sanitise(docs: DataFrame, doc_id: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, text): every mention replaced by its kind's placeholder, all else as it was; null stays null.

    Texts are changed where they are read, none is shuffled. Only with more than ``max_terms`` revealing terms do mentions meet their
    texts by id and text. Of mentions that overlap the one that begins first is replaced, of these the longest. A row comes out for each row.
    """
    rows = _rows(docs, doc_id, text)
    shared, exact, terms = _learnt(rows, max_terms)
    if exact:
        return rows.mapInPandas(_clean(shared), "doc bigint, text string").withColumnRenamed("doc", doc_id)
    keyed = rows.withColumn("key", F.sha2(F.col("text"), 256))
    once = keyed.where("text <> ''").dropDuplicates(["key"]).withColumn("doc", F.xxhash64("key"))
    found = _verified(once.select("doc", "text").mapInPandas(_find(shared, False), _FOUND), terms)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    joined = keyed.withColumn("at", F.xxhash64("key")).join(spans.withColumnRenamed("doc", "at"), "at", "left").select("doc", "text", "spans")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = [t if s is None or t is None else _replaced(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(f["text"], f["spans"], strict=True)]
            yield pd.DataFrame({"doc": f["doc"], "text": new})

    return joined.mapInPandas(run, "doc bigint, text string").withColumnRenamed("doc", doc_id)
