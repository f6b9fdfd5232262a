"""Personal information in free text: anchors by Aho-Corasick, expanded and validated by local parsers, replaced by typed placeholders.

One automaton runs once over a text (in lower case, all digits as 0) and finds at-signs in all their disguises, schemes, shapes of numbers, identifier cues,
street words, titles, initials, given names and words that names follow. Each anchor's place goes to the parser of its kind, which expands it to the left and right to the
whole item and validates that: labels and top level of a domain, digits by numbering form, check letters and dates of bare identity numbers, a house number
beside a street word, a family name beside a given name, initial or title. Nothing is looked for where no anchor is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
EMAIL, PHONE, ID, STREET, NAME = range(5)

GIVEN = """abena aisha alice amina anna arjun astrid camille carlos carys chiara claire daniel david diego dmitri elena elise emma erik
fatima freya george giulia greta hana helen hugo ines ingrid irene ivan james jan jana john josé jose julia jürgen kenji kwame lars
laura leila louis lucas lucia lukas maeve marco maria marta martin mary mei michael milan mohammed nadia niall ngozi noor olga
omar oskar owen pablo paolo peter piotr priya rachel ravi rhys robert rosa samir sarah simon sofia sunita susan søren soren tariq
thandi thomas tomas tunde vesna victor wei yusuf zofia zoë zoe paul linda lena pierre jean karl hans anders bjorn björn
yuki akira chen li ali ahmed hassan omari ana luis juan pedro miguel andre andré marie sophie nina eva kate emily jack henry william
charles edward richard joseph anthony mark steven kevin brian""".split()
TITLES = "mr mrs ms miss dr prof herr frau mme mlle sra sr dña don sig sig.ra m. monsieur madame señora señor".split()
#: Words that a person's name follows in code, documents and metadata.
NAME_CUES = ("@author", "author", "authors", "written by", "reported by", "reviewed by", "reviewed with", "maintained by", "maintainer", "created by", "signed-off-by", "co-authored-by", "thanks to", "contact", "contacter", "ask", "call", "todo(", "fixme(",
             "owner", "patient", "customer", "ansprechpartner", "ansprechpartnerin", "(c)", "copyright", "passport no", "name", "fullname", "full name", "assignee", "attn")
#: Words before which the one who said something stands.
SAID = ("asked", "noted", "said", "wrote", "reported", "suggested", "mentioned", "confirmed", "complained")
PHONE_CUES = ("tel", "phone", "telephone", "telefon", "fax", "hotline", "mobile", "handy", "ring", "dial", "call")
#: How phone numbers and identity numbers without a cue are grouped.
NUMBER_SHAPES = ("+0", "(0", "(+", "000-000", "000.000", "000 000", "0000 00", "0000-00", "0000.00", "000/0000", "00 00 00", "00.00.00", "00-00-00", "000-00-0000", "00000000", "x0000000", "y0000000", "z0000000", "aa000000", "qq")
ID_CUES = ("ssn", "social security", "itin", "tax", "tin", "taxid", "steuer", "national id", "national_id", "national-id", "national identity", "national insurance", "ni number", "nino", "dni", "nie", "nif", "personnummer", "passport", "passeport", "reisepass",
           "driver", "driving", "licence no", "license no", "licence number", "license number", "licence #", "license #", "führerschein", "fuhrerschein", "personalausweis", "codice fiscale", "id number", "id no", "id-number", "id_number", "id card", "id-card", "identity", "cpf", "pesel", "curp", "cnp", "bsn", "aadhaar", "nir")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "way", "court", "ct", "terrace", "crescent", "close", "square", "sq", "parade", "boulevard", "blvd", "place", "pl", "grove", "gardens", "row", "hill", "mews", "highway", "hwy", "parkway", "pkwy")
STREETS_FIRST = ("rue", "avenue", "chemin", "boulevard", "place", "allée", "quai", "impasse", "route", "calle", "avenida", "plaza", "paseo", "camino", "via", "viale", "piazza", "corso", "largo", "rua", "travessa")
STREETS_END = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring")
#: Top levels that are file endings: `logo@2x.png` is no address.
FILES = frozenset("png jpg jpeg gif svg webp ico js mjs ts tsx jsx css json xml yml yaml toml md txt py go rb rs php java sh sql html lock cfg ini env csv tf log zip gz tar jar".split())
#: Capitalised words that stand behind a given name without being a family name: common nouns of software, organisations, teams and places, weekdays and months.
PLAIN = frozenset("""gateway service server client team group project dashboard theme engine cluster release system tool tooling cooperative foundation
inc ltd llc gmbh corp company labs bot api key token secret password user admin main master module package parser builder runner worker router queue cache logger tracer
bridge adapter filter hook index scanner scheduler schema registry report linter loader matcher merger mirror monitor pipeline planner probe proxy resolver ruleset snapshot socket
sorter splitter stream template toolchain walker workspace archive buffer bundle digest exporter formatter handler importer listing lockfile manifest engineering
street road avenue lane drive court square parade plaza place office building tower ridge sort search view widget started detection basic component
license licence version file line page chapter section table figure note todo fixme the this that these those and for with from when what where which while after before if in on at by to of as is are was use used using note no not all any each every
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split())

UP = r"\p{Lu}"
WORD = rf"{UP}(?:\p{{L}}+|['’]\p{{L}}+)(?:['’]\p{{L}}+)*"
FAMILY = rf"{WORD}(?:-{WORD})?"
INITIAL = rf"{UP}\."
GIVEN_RE = "(?:" + "|".join(sorted((regex.escape(g) for g in GIVEN), key=len, reverse=True)) + ")"
TITLE_RE = r"(?i:\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sra|sr|sig|monsieur|madame|señora|señor)\b\.?)"
PARTICLE = r"(?:(?:van|von|de|der|den|la|di|da|del|dos|el|al|bin) ){0,2}"
NAME_FORMS = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.@/-])(?:{TITLE_RE} )?(?P<given>(?i:{GIVEN_RE}))(?:-{WORD})? (?:{INITIAL} ?){{0,2}}(?P<family>{PARTICLE}{FAMILY})(?![\p{{L}}\p{{N}}_@])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.@/-])(?P<family>{FAMILY}), ?(?P<given>(?:{TITLE_RE} )?(?:(?i:{GIVEN_RE})|{INITIAL}))(?![\p{{L}}\p{{N}}_@])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.@/-])(?P<given>{TITLE_RE}) (?:{INITIAL} ?){{0,2}}(?P<family>{PARTICLE}{FAMILY})(?![\p{{L}}\p{{N}}_@])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.@/-])(?P<given>{INITIAL})(?: ?{INITIAL}){{0,2}} (?P<family>{PARTICLE}{WORD}(?:-{WORD})?)(?![\p{{L}}\p{{N}}_@])"),
]
#: Given and family name in either order.
EITHER = rf"(?P<item>(?:{TITLE_RE} )?(?:(?P<given>{WORD}) (?:{INITIAL} ?){{0,2}}(?P<family>{FAMILY})|(?P<family>{FAMILY}), (?P<given>{WORD})))"
#: A title before given and family name.
TITLED = regex.compile(rf"(?P<item>{TITLE_RE} (?P<given>{WORD}) (?:{INITIAL} ?){{0,2}}(?P<family>{FAMILY}))(?![\p{{L}}\p{{N}}_@])")
#: A name behind one of `NAME_CUES`; its first word needs not be a known given name.
CUED_NAME = regex.compile(
    rf"(?:['\"]?\s?[:=(>]?\s?[\"'`({{\[]*|\s?\d{{4}}\s|\W{{0,2}}\s?[A-Z]{{2}}\d{{5,9}} for ){EITHER}(?![\p{{L}}\p{{N}}_@])"
)
#: A name right before an address or number: `Name <address>`, `"Name";"number"`, `"name": "Name", "email": "address"`, `Name, 12 Some Street`.
FIELD_BEFORE = regex.compile(
    rf"(?r)(?:^|[\"'`|;,:(>#*/.!?-]|\p{{Ll}})\s?{EITHER}(?:\s?[<(]|[\"']?\s?(?:[;|,]\s?[\"']{{0,2}}){{1,2}}|\s\p{{Ll}}{{2,3}}\s|[\"'],\s?[\"'](?:e-?mail|mail|tel|phone|address)[\"']:\s?[\"'])(?:mailto:|tel:)?$"
)
#: A name behind an identity number: `12-345 for Name`.
FIELD_AFTER = regex.compile(rf"\s(?:for|of|by)\s{EITHER}(?![\p{{L}}\p{{N}}_@])")
#: A name before a word of `SAID`.
SAYS = regex.compile(rf"(?r)(?:^|[\"'`|;,:(>#*/.!?-]|\p{{Ll}})\s?{EITHER}\s$")

AT_PLAIN = r"(?:@|＠|&#0*64;|&#x0*40;|&commat;|%40|\\u0040|\\x40)"
AT_WORD = r"(?:\s*[\[({<]\s*(?i:at|@)\s*[\])}>]\s*|_at_)"
DOT = r"(?:\.|\s*[\[({]\s*(?i:dot|\.)\s*[\])}]\s*|\s+(?i:dot)\s+|&#0*46;|%2E)"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
AT = regex.compile(rf"{AT_PLAIN}|{AT_WORD}")
AT_SPOKEN = regex.compile(r"\s+(?i:at)\s+")
DOMAIN = regex.compile(rf"{LABEL}(?:{DOT}{LABEL})*?{DOT}(?P<top>\p{{L}}{{2,24}})(?![\p{{L}}\p{{N}}_-]|\.\p{{L}})")
DOMAIN_SPOKEN = regex.compile(rf"{LABEL}(?:\s+(?i:dot)\s+{LABEL})*\s+(?i:dot)\s+(?P<top>\p{{L}}{{2,24}})(?![\p{{L}}\p{{N}}_-]|\.\p{{L}})")
#: What can't stand between a scheme and the end of a user part.
OUTSIDE_USER = regex.compile(r"[\s/'\"<>]")

#: Numbering forms; the named ones need a check of their digits.
PHONE_RE = regex.compile(
    r"""(?<![\p{L}\p{N}_.+-])(?<!\d[ /:])(?:
      (?P<intl>(?:\+|00(?=[1-9]))[1-9]\d{0,2}(?:[ .-]?\(0\))?(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,6})){2,6})
    | \(\d{3}\)[ ]?\d{3}[-. ]\d{4} | \(0\d{1,5}\)[ ]?\d{3,8}(?:[ -]\d{2,4})?
    | (?:1(?P<s0>[-. ]))?[2-9]\d{2}(?P<s>[-. ])\d{3}(?P=s)\d{4}
    | 0\d{2,5}/\d{4,8}(?:-\d{1,4})?
    | 0\d{3}[ ]\d{3}[ ]\d{3} | 0\d{4}[ ]\d{3}[ ]?\d{3} | 0\d{2}[ ]\d{4}[ ]\d{4} | 0\d(?P<s2>[ .-])\d{2}(?:(?P=s2)\d{2}){3}
    )(?:,?[ ](?:ext\.?|x)[ ]?\d{1,5})?(?![\p{L}\p{N}_]|[.-]\d)""",
    regex.X,
)
CUED_PHONE = regex.compile(r"(?i)(?<!\p{L})(?:tel(?:efon|ephone|\.)?|phone|fax|hotline|mobile|handy|ring|dial|call(?: on)?)(?:\W{1,4}|\W{1,3}no\.? )(?P<item>\+?\(?\d[\d ()./-]{5,18}\d)(?![\p{L}\p{N}_]|[.-]\d)")

ID_CUE = r"""(?:social\ security(?:\ (?:number|no\.?))?|ssn|itin|tax[\ _-]?(?:payer)?[\ _-]?id(?:entification)?(?:\ (?:number|no\.?))?|tin|steuer-?id(?:nummer|entifikationsnummer|-?nr\.?)?|steuernummer
 |national[\ _-]id(?:entity)?(?:\ (?:number|card|no\.?))?|national\ insurance(?:\ (?:number|no\.?))?|ni\ number|nino|dni(?:/nie)?|nie|nif|personnummer|pass(?:port|eport)(?:[\ _](?:number|no\.?|nr\.?))?|reisepass(?:-?nr\.?|nummer)?
 |(?:driv(?:er|ing)(?:'?s)?[\ _-])?licen[cs]e\ (?:number|no\.?|\#)|driv(?:er|ing)(?:'?s)?[\ _-]licen[cs]e|f[uü]hrerschein(?:-?nr\.?|nummer)?|personalausweis(?:-?nr\.?|nummer)?|codice\ fiscale|id(?:entity)?[\ _-](?:card\ )?(?:number|no\.?)|cpf|pesel|curp|cnp|bsn|aadhaar|nir|taxid|tax_id|identity)"""
ID_RE = regex.compile(
    rf"(?ix)(?<![\p{{L}}\p{{N}}]){ID_CUE}(?!\p{{L}})[\"'`]?[\ :=\#>\"'`]{{1,5}}(?:(?:is|no\.?|nr\.?|number|DNI|SSN|NIE)[\ :]{{1,2}})?(?P<item>(?:\p{{Lu}}{{1,6}}[\ -]?)?\d(?:[\ ./-]?\d){{3,19}}(?:[\ -]?\p{{L}}(?![\p{{L}}\p{{N}}]))?)(?![\p{{L}}\p{{N}}])"
)
#: Numbers that tell by their form alone what they are. Areas and prefixes that no state gives out (000, 666, 9xx; QQ) count, for those stand in examples and test records.
BARE_ID = regex.compile(r"(?<![\p{L}\p{N}_./-])(?:(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<nino>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D])|(?P<born>(?:19|20)\d{6}-\d{4})|(?P<dni>\d{8}-?[TRWAGMYFPDXBNJZSQVHLCKE])|(?P<nie>[XYZ]\d{7}[A-Z]))(?![\p{L}\p{N}_-]|\.\d)")
# The check letters of Spanish identity numbers, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

HOUSE = r"\d{1,5}(?: ?[A-Za-z](?![\p{L}\p{N}]))?(?:[-/]\d{1,4}[A-Za-z]?)?"
NAMED = rf"{UP}[\p{{L}}'’.-]*"
END_RE = "|".join(sorted(STREETS, key=len, reverse=True))
FIRST_RE = "|".join(sorted(STREETS_FIRST, key=len, reverse=True))
LINK = r"(?:(?:de|du|des|del|della|dei|delle|dello|da|do|dos|la|le|les|los|las|l'|d') ?){0,3}"
STREET_FORMS = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_./-])(?:(?:Unit|Apt|Flat|Suite) \d{{1,5}}, )?{HOUSE},? (?:{NAMED} ){{1,4}}(?i:{END_RE})\b\.?(?![\p{{L}}\p{{N}}_-])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_./-])(?:{NAMED} ){{1,3}}(?i:{END_RE})\b\.? {HOUSE}(?=\s*(?:[,;|\"'<)\]]|$|\p{{P}}))"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_./-]){HOUSE},? (?i:{FIRST_RE}) {LINK}{NAMED}(?: {NAMED}){{0,3}}"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_./-])(?i:{FIRST_RE}) {LINK}{NAMED}(?: {NAMED}){{0,3}},? (?:n[.ºo°]* ?)?{HOUSE}(?![\p{{L}}\p{{N}}_])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_./-]){UP}[\p{{L}}-]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm) {HOUSE}(?![\p{{L}}\p{{N}}_])"),
]

# Anchors


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Lower-case anchor, with digits as 0, to (its length, whether it must stand as a word, the kinds of parsers it calls)."""
    found: dict[str, tuple[bool, list[str]]] = {}

    def add(parser: str, words: tuple | list, word: bool = False) -> None:
        for w in words:
            whole, parsers = found.setdefault(w, (word, []))
            found[w] = whole and word, [*parsers, parser]

    add("at", ["@", "＠", "&#00;", "&#x00;", "&#000;", "&commat;", "%00", "\\u0000", "\\x00", "(at", "[at", "{at", "<at", "_at_", "( at", "[ at", "{ at", " at "])
    add("number", NUMBER_SHAPES)
    add("called", PHONE_CUES, True)
    add("identity", ID_CUES, True)
    add("street", STREETS, True)
    add("street_first", STREETS_FIRST, True)
    add("street_end", [w for w in STREETS_END if w != "ring"])
    add("given", GIVEN, True)
    add("title", TITLES, True)
    add("initial", [". "])
    add("cue", NAME_CUES, True)
    add("said", SAID, True)
    automaton = ahocorasick.Automaton()
    for w, (whole, parsers) in found.items():
        automaton.add_word(w, (len(w), whole and w[0].isalpha(), whole and w[-1].isalpha(), tuple(parsers)))
    automaton.make_automaton()
    return automaton


#: Characters before an item in which a name beside it is looked for; no name with its titles and marks is longer.
LONGEST = 120
ZEROS = str.maketrans("123456789", "000000000")
LOCAL_SIGNS, RUN_SIGNS = frozenset("._+'-"), frozenset("0123456789 ()./+-")


def lowered(text: str) -> str:
    """Lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


# Parsers: (text, start of the anchor, its end, start and end of its line) to spans


def email_at(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Left over the local part, right over the labels of the domain."""
    at = s
    while at > first and text[at - 1].isspace():
        at -= 1
    if text[s].isspace():
        sign, domain = AT_SPOKEN.match(text, at, last), DOMAIN_SPOKEN
    else:
        sign, domain = AT.match(text, at, last) or AT.match(text, s, last), DOMAIN
    if not sign:
        return
    at = sign.start()
    host = domain.match(text, sign.end(), last)
    if not host or host["top"].lower() in FILES:
        return
    a = at
    while a > first and (text[a - 1].isalnum() or text[a - 1] in LOCAL_SIGNS or text[a - 1] == "\u0301"):
        a -= 1
    while a < at and text[a] == "'":
        a += 1
    if a == at or not (text[a].isalnum() or text[a] == "_") or not (text[at - 1].isalnum() or text[at - 1] in "_+-") or a > first and text[a - 1] == "%":
        return
    whole, after = text[a : host.end()], text[host.end() : min(host.end() + 2, last)]
    scheme = text.rfind("://", first, a)
    if whole.lower() == "redacted@example.org" or scheme >= 0 and not OUTSIDE_USER.search(text, scheme + 3, a):
        return
    if after[:1] == ":" and after[1:].strip() and "@" in whole and (text[a:at] == "git" or after[1:] not in ("\\", '"', "'")):
        return  # host:path of a git remote
    yield a, host.end()


def number_run(text: str, s: int, e: int, first: int, last: int) -> tuple[int, int]:
    """The run of digits and their separators around an anchor."""
    while s > first and text[s - 1] in RUN_SIGNS:
        s -= 1
    while e < last and text[e] in RUN_SIGNS:
        e += 1
    return s, e


def phones_in(text: str, s: int, e: int, last: int) -> Iterator[tuple[int, int]]:
    at = s
    while at < e:
        m = PHONE_RE.match(text, at, last) if text[at] in "+(0123456789" else None
        if m and (not m.group("intl") or 8 <= sum(c.isdigit() for c in m.group()) <= 20):
            yield m.span()
        at = m.end() if m else at + 1


def bare_ids_in(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Identity numbers that need no cue; those with a check letter or a date are checked by it."""
    at = max(first, s - 2)
    while at < e:
        m = BARE_ID.match(text, at, last) if text[at].isalnum() else None
        if m and valid_id(m):
            yield m.span()
        at = m.end() if m else at + 1


def valid_id(m: regex.Match) -> bool:
    digits = "".join(c for c in m.group() if c.isdigit())
    if m["ssn"]:
        return digits[3:] != "000000"
    if m["born"]:
        return 1 <= int(digits[4:6]) <= 12 and 1 <= int(digits[6:8]) <= 31
    if m["dni"]:
        return DNI_LETTERS[int(digits) % 23] == m.group()[-1]
    if m["nie"]:
        return DNI_LETTERS[int(f"{'XYZ'.index(m.group()[0])}{digits}") % 23] == m.group()[-1]
    return True


def called_number(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    m = CUED_PHONE.match(text, s, last)
    if m and 7 <= sum(c.isdigit() for c in m["item"]) <= 15:
        yield m.span("item")


def identity_number(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    m = ID_RE.match(text, s, last)
    if m and sum(c.isdigit() for c in m["item"]) >= 5:
        yield m.span("item")


def word_starts(text: str, s: int, first: int, n: int) -> Iterator[int]:
    """Starts of the word at s and of up to n words before it, the nearest first."""
    yield s
    while n and s > first:
        s -= 1
        while s > first and text[s].isspace():
            s -= 1
        while s > first and not text[s - 1].isspace() and text[s - 1] not in "\"'`;|(<>[]{}=#*,":
            s -= 1
        yield s
        n -= 1


def street_by_end(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """A house number before or behind a name and a street word."""
    found = None
    for at in word_starts(text, s, first, 9):
        m = STREET_FORMS[0].match(text, at, last)
        if m and m.start() < s and m.end() >= e:
            found = m
    if not found:
        for at in word_starts(text, s, first, 3):
            m = STREET_FORMS[1].match(text, at, last)
            if m and m.start() < s and m.end() >= e:
                found = m
    if found:
        yield found.span()


def street_by_start(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    for at in word_starts(text, s, first, 2):
        m = STREET_FORMS[2].match(text, at, last)
        if m and m.start() < s and m.end() > e:
            yield m.span()
            return
    m = STREET_FORMS[3].match(text, s, last)
    if m:
        yield m.span()


def street_by_part(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Street words that are the end of the name: Mühlweg 20."""
    while s > first and (text[s - 1].isalpha() or text[s - 1] == "-"):
        s -= 1
    m = STREET_FORMS[4].match(text, s, last)
    if m and m.end() > e:
        yield m.span()


def person(m: regex.Match | None, item: str | int = 0) -> Iterator[tuple[int, int]]:
    if m and plausible(m["family"]) and (m["given"][0].isupper() or m["given"][0] == "@") and (not item or plausible(m["given"])):
        yield m.span(item)


def name_by_given(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """A known given name: the family name behind it, or before it and a comma; with the title before."""
    found = [*person(NAME_FORMS[0].match(text, s, last))]
    for at in word_starts(text, s, first, 3):
        found += person(m) if (m := NAME_FORMS[1].match(text, at, last)) and m.end() >= e else ()
    yield from found


def name_by_title(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    yield from person(NAME_FORMS[0].match(text, s, last))
    yield from person(TITLED.match(text, s, last), "item")
    yield from person(NAME_FORMS[2].match(text, s, last))
    for at in word_starts(text, s, first, 2):
        yield from person(NAME_FORMS[1].match(text, at, last))


def name_by_initial(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """An initial (the anchor is its full stop): the family name behind it, or before it and a comma."""
    if s == first or not text[s - 1].isupper() or s - 1 > first and text[s - 2].isalnum():
        return
    yield from person(NAME_FORMS[3].match(text, s - 1, last))
    for at in word_starts(text, s - 1, first, 2):
        yield from person(NAME_FORMS[1].match(text, at, last))


def name_by_cue(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    yield from person(CUED_NAME.match(text, e, last), "item")


def name_before_verb(text: str, s: int, e: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    start = max(first, s - LONGEST)
    yield from ((start + a, start + b) for a, b in person(SAYS.search(text[start:s]), "item"))


def names_beside(text: str, a: int, b: int, kind: int) -> Iterator[tuple[int, int]]:
    """Names in the field before an address or number, and behind an identity number."""
    start = max(text.rfind("\n", 0, a) + 1, a - LONGEST)
    if kind == ID:
        yield from person(FIELD_AFTER.match(text, b), "item")
    else:
        yield from ((start + x, start + y) for x, y in person(FIELD_BEFORE.search(text[start:a]), "item"))


def plausible(family: str) -> bool:
    parts = [p for p in regex.split(r"[-\s]", family) if p and p[0].isupper()]
    return bool(parts) and all(len(p) > 1 and p.lower() not in PLAIN for p in parts)


PARSERS = {
    "at": (EMAIL, email_at), "called": (PHONE, called_number), "identity": (ID, identity_number), "street": (STREET, street_by_end), "street_first": (STREET, street_by_start), "street_end": (STREET, street_by_part),
    "given": (NAME, name_by_given), "title": (NAME, name_by_title), "initial": (NAME, name_by_initial), "cue": (NAME, name_by_cue), "said": (NAME, name_before_verb),
}
#: Of items that overlap, the first of this order stays.
RANK = {EMAIL: 0, ID: 1, PHONE: 2, STREET: 3, NAME: 4}


def find_items(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, end, line number from 1, kind) of every item of a text, of any length, in order; none for null and empty texts. Items don't
    overlap and don't go beyond a line."""
    if not text:
        return []
    found: set[tuple[int, int, int]] = set()
    low = lowered(text)
    first, last, done = 0, -1, -1
    for end, (length, left, right, parsers) in anchors().iter(low.translate(ZEROS)):
        s, e = end + 1 - length, end + 1
        if left and s and low[s - 1].isalpha() or right and e < len(low) and low[e].isalpha():
            continue
        if e > last:
            first = text.rfind("\n", 0, s) + 1
            last = text.find("\n", s)
            last = len(text) if last < 0 else last
            if e > last:
                continue
        for name in parsers:
            if name == "number":
                if s < done:
                    continue  # in a run that was read
                a, done = number_run(text, s, e, first, last)
                found.update((x, y, PHONE) for x, y in phones_in(text, a, done, last))
                found.update((x, y, ID) for x, y in bare_ids_in(text, a, done, first, last))
            else:
                kind, parser = PARSERS[name]
                found.update((x, y, kind) for x, y in parser(text, s, e, first, last))
    for a, b, kind in list(found):
        if kind != NAME:
            found.update((x, y, NAME) for x, y in names_beside(text, a, b, kind))
    taken: list[tuple[int, int, int]] = []
    for a, b, kind in sorted(found, key=lambda x: (RANK[x[2]], x[0], -x[1])):
        at = bisect_right(taken, (a,))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, kind))
    out, line, at = [], 1, 0
    for a, b, kind in taken:
        line += text.count("\n", at, a)
        at = a
        out.append((a, b, line, KINDS[kind]))
    return out


def redact(text: str | None) -> str | None:
    """`text` with every item replaced by its placeholder, such as [EMAIL]; null stays null."""
    if not text:
        return text
    out, last = [], 0
    for start, end, _, kind in find_items(text):
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


def personal_items(df: DataFrame, row_id: str = "file_id", content: str = "content") -> DataFrame:
    """Rows (row_id, line_no, kind, start, end) of every item; offsets are code points into the text. Null and empty texts give no
    rows; other columns are not read; a repeated row gives its items again. No shuffle: one pass over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, kind, a, b) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, n, kind in find_items(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["id", "line_no", "kind", "start", "end"],
            )

    kind = dict(df.dtypes)[row_id]
    return df.select(F.col(row_id), F.col(content).cast("string")).mapInArrow(run, f"id {kind}, line_no bigint, kind string, start bigint, end bigint").withColumnRenamed("id", row_id)


def redact_personal(df: DataFrame, content: str = "content") -> DataFrame:
    """`df` with the items of `content` replaced by placeholders; all other columns, and null, as they were."""
    redacted = F.pandas_udf(lambda texts: texts.map(redact), "string")
    return df.withColumn(content, redacted(F.col(content)))
