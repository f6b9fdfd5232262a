"""Credentials in source code and configuration: a linear-chain CRF labels the lexical tokens of a line, the Viterbi spans are redacted."""

from __future__ import annotations

import base64
import random
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import LinearChain

#: The bounded labelled sample that the field is fitted on: made lines of known labels, from a fixed seed.
TRAINING_LINES = 4000
SEED = 11
#: O: other, K: the name of a credential, C: between the name and its value, V: literal credential.
LABELS = ("O", "K", "C", "V")
O, K, C, V = range(4)

CRED_WORDS = frozenset("password passwd passphrase passwort passcode pass pwd pw psw secret token apikey bearer credential credentials auth authorization contrasena contraseña passe kennwort senha authtoken basic clientsecret secretkey".split())
KEY_WORDS = frozenset("api private secret access encryption signing session host master ssh deploy license service account shared".split())
LABEL_WORDS = frozenset("label type header path reset length min max days rotation field prompt hint policy count ttl expiry expires file env placeholder url uri regex pattern name enabled ref manager store timeout".split())
ID_WORDS = frozenset("etag commit revision checksum integrity uuid trace build asset sha sha256 sha512 digest logo icon font image hash fingerprint version public md5".split())
PLACEHOLDERS = frozenset("changeme change_me todo tbd none null nil true false undefined example dummy placeholder redacted yourpassword hidden masked string sample test xxx foo bar default empty".split())
#: How tokens of known issuers start, by what follows.
PREFIXES = {
    r"[A-Z0-9]{6,}": "AKIA ASIA", r"\w{8,}": "ghp_ gho_ ghu_ ghs_ ghr_ sk_live_ sk_test_ rk_live_ pk_live_ npm_", r"\w+": "github_pat_", r"[\w-]{8,}": "xoxa- xoxb- xoxp- xoxr- xoxs-", r"[\w-]{6,}": "glpat-",
    r"[\w-]{16,}": "pypi-", r"[\w-]{20,}": "AIza", r"[\w.-]{16,}": "SG.", r"(?:[\w-]{8,}\.[\w.-]*|[\w-]{30,})": "eyJ",
}
#: Tokens that name their issuer by a short word, and often the stage, before the random part.
BRANDED = regex.compile(r"[a-z]{2,8}[_-](?:(?:live|prod|test|dev|stage|staging|sandbox|key|pat|sk|pk)[_-])?(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{16,}")
CONTACT = regex.compile(r"(?:mailto:)?[\w.+%-]+(?:@|%40|&#64;)[\w.-]+\.\p{L}{2,}|(?:tel:)?\+?[\d ()./-]{6,}(?:x\d+)?")
PREFIXED = regex.compile("|".join(f"(?:{'|'.join(map(regex.escape, starts.split()))}){rest}" for rest, starts in PREFIXES.items()))

TOKEN = regex.compile(
    r"""(?P<pem>-{5}BEGIN\ [A-Z0-9 ]*-{5})
      | (?P<url>[A-Za-z][\w+.-]*://)(?P<user>[^\s:/@"'`]*):(?P<pw>\{\{.*?\}\}|<[^<>\s]*>|%\([^)]*\)s|[^\s/"'`@<>]+)(?=@)
      | (?P<whole>data:[\w/+.-]+;base64,[\w+/=]*|sha\d{1,3}[-:][\w+/=]+|\$?\{\{(?:(?!\{\{).)*?\}\}|\$\{(?:(?!\$\{)[^}])*\}|\$\((?:(?!\$\()[^)])*\)|%\([^()]*\)s)
      | (?P<quoted>(?P<q>["'`])(?P<in>(?:\\.|(?!(?P=q)).)*)(?P=q))
      | (?P<sep>=>|:=|==|\|\||[=:,;|<>()\[\]{}"'`])
      | (?P<word>[^\s"'`<>()\[\]{}=:,;|]+(?:(?<=[\w+/-]{16})={1,2}(?=$|[\s"'`,;)<]))?)""",
    regex.X,
)
PAIR_IN_QUOTES = regex.compile(r"[A-Za-z_]\w{2,}=[^=].{3}")
INNER = regex.compile(r"\s|://|^data:|^sha\d+[-:]|-----BEGIN")
SUBWORD = regex.compile(r"[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|\d+")
#: Words joined by dots or the like, no random text.
LONG_NAME = regex.compile(r"(?:[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*)\d{0,2}(?:\[\d+\])?(?:[._-](?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)?\d{0,2}(?:\[\d+\])?)+")
SECRET_FILE = regex.compile(r"(?i)(?:^|/)(?:\.pgpass|\.netrc|\.vault_pass\w*|\.htpasswd|[\w.-]*(?:pass(?:word|wd)?|secret|token|credential)s?(?:\.txt|\.key)?|[\w-]+[._]key|id_\w+)$")
SKIPPED = frozenset("! is was with by string const var let export set - # // /* * || : = => := ( ) [ ] { } < > , ; | \" ' ` basic bearer value final static private -h".split())

Token = tuple[int, int, str, str]


def lex(text: str, at: int = 0) -> list[Token]:
    """(start, end, text, class) of the lexical tokens of a line: word, str, sep, pem, scheme, user, pw, whole."""
    out: list[Token] = []
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        a, b = m.span()
        if kind in ("word", "sep", "whole", "pem"):
            out.append((at + a, at + b, m[0], kind))
        elif kind == "pw":
            out += [(at + m.start(g), at + m.end(g), m.group(g), c) for g, c in (("url", "scheme"), ("user", "user"), ("pw", "pw")) if m.group(g)]
        else:
            inner, i = m["in"], m.start("in")
            out.append((at + a, at + a + 1, m.group("q"), "sep"))
            if not inner:
                pass
            elif INNER.search(inner) or PAIR_IN_QUOTES.match(inner) or m.group("q") == "'" and a and text[a - 1].isalpha():
                out += lex(inner, at + i)
            else:
                out.append((at + i, at + i + len(inner), inner, "str"))
            out.append((at + m.end() - 1, at + m.end(), m.group("q"), "sep"))
    return out


#: The kind of a name is that of its last parts, which stand in its last characters.
NAME_PARTS, NAME_CHARS = 7, 300


@lru_cache(maxsize=1 << 15)
def key_kind(word: str) -> str:
    """cred, label, id or nothing, by the parts of an identifier; by the last ones of a long name."""
    name = word.rpartition("/")[2].lstrip("$@-:")
    long = len(word) > 60
    parts = [p.lower() for p in SUBWORD.findall(name[-NAME_CHARS:])]
    if long or len(parts) > NAME_PARTS:
        if not LONG_NAME.fullmatch(name):
            return ""
        parts = parts[-NAME_PARTS:]
    if not parts:
        return ""
    joined = "".join(parts)
    cred = any(p in CRED_WORDS for p in parts) or ("key" in parts and (any(p in KEY_WORDS for p in parts))) or joined in CRED_WORDS or "password" in joined or "passwort" in joined
    if cred or "key" in parts:
        if any(p in LABEL_WORDS for p in parts[1:]):
            return "label"
        return "cred" if cred else ""
    return "id" if any(p in ID_WORDS for p in parts) else ""


CHECKSUM = regex.compile(r"sha\d+[-:]")
HASHED = regex.compile(r"[a-z]+[_-][0-9a-f]+")
NAME_ONLY = regex.compile(r"[\p{L}_.-]+")
REFERENCE = regex.compile(r"\$\{|\{\{|\$\(|%\(|\$[A-Za-z_][\w.]*$|%[\w.]+%$|\[?redacted|process\.env|os\.|getenv|env\.|vault")
MASK = frozenset("*x.-_")
UUID = regex.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
HEX = regex.compile(r"[0-9a-f]{16,}")
NUMBER = regex.compile(r"[\d.,:-]+")
PATH = regex.compile(r"/[\w./-]*|\.{1,2}/[\w./-]*|[\w-]+(?:/[\w.-]+)+")
DIGIT_AND_CAPITAL = regex.compile(r"\d.*[A-Z]|[A-Z].*\d")
CLASSES = tuple(map(regex.compile, (r"[a-z]", r"[A-Z]", r"\d", r"[^\p{L}\p{N}]")))
PHRASE = regex.compile(r"\p{L}+-\p{L}+-\d+\p{L}+")
PLAIN = regex.compile(r"\p{Ll}+|\p{Lu}+|\p{Lu}\p{Ll}+")
RANDOM = regex.compile(r"[\w+/=.-]+")
DOTTED = regex.compile(r"[\p{L}_][\p{L}\d]*(?:[._-][\p{L}\d]+)*\(?\)?")
USUAL = regex.compile(r"[\p{Ll}\d]+(?:\p{Lu}[\p{Ll}\d]+)*|(?:\p{Lu}[\p{Ll}\d]+)+|\p{Lu}[\p{Lu}\d]*|\p{Ll}+\p{Lu}{2,4}")
USUAL_PART = regex.compile(r"[\p{Ll}\d]*|[\p{Lu}\d]*|\p{Lu}[\p{Ll}\d]*")
APART = regex.compile(r"[._-]")


@lru_cache(maxsize=1 << 16)
def value_kind(text: str) -> str:
    """What a token looks like as a value."""
    low = text.lower().strip(".")
    if text.startswith("-----BEGIN"):
        return "private" if "PRIVATE" in text else "public"
    if low.startswith("data:"):
        return "datauri"
    if CHECKSUM.match(low):
        return "checksum"
    if PREFIXED.match(text):
        return "prefixed"
    if BRANDED.fullmatch(text) and not HASHED.fullmatch(text):
        return "branded"
    if CONTACT.fullmatch(text):
        return "contact"
    if text.startswith("AAAA") and len(text) >= 40:
        return "public"  # of a public key
    if key_kind(text) in ("cred", "label") and NAME_ONLY.fullmatch(text):
        return "placeholder"  # a credential's name in place of its value
    if low in PLACEHOLDERS or low.startswith(("your_", "your-", "my_", "my-", "<", "replace")) or MASK.issuperset(low) or REFERENCE.match(low):
        return "placeholder"
    if UUID.fullmatch(low):
        return "uuid"
    if HEX.fullmatch(low) and any(c.isdigit() for c in low):
        return "hex40" if len(low) in (40, 64) else "hex"
    if NUMBER.fullmatch(text):
        return "number"
    if PATH.fullmatch(text) and not DIGIT_AND_CAPITAL.search(text):
        return "path"
    classes = sum(c.search(text) is not None for c in CLASSES)
    if PHRASE.fullmatch(text):
        return "phrase"
    if PLAIN.fullmatch(text):
        return "plain"
    if len(text) >= 20 and classes >= 2 and RANDOM.fullmatch(text) and CLASSES[2].search(text) and CLASSES[1].search(text):
        return "random"
    if DOTTED.fullmatch(text) and not (CLASSES[2].search(text) and classes >= 2):
        usual = USUAL.fullmatch(text) or all(USUAL_PART.fullmatch(p) for p in APART.split(text.rstrip("()")))
        return "name" if usual or len(text) < 6 else "mixed"
    return "mixed" if classes >= 2 and len(text) >= 6 else "short"


Key = tuple


def skipped(word: str) -> bool:
    """Whether a word may stand between a name and its value; so may a tag of YAML."""
    return word in SKIPPED or word[:1] == "!" and word[1:].isalpha()


@lru_cache(maxsize=1 << 16)
def shape(text: str, cls: str) -> tuple[str, str, tuple | None, bool, bool, bool]:
    """What a token is by itself: lower case; kind of name; the part of its key that doesn't depend on its place (none for separators); whether it may stand between a name and
    its value, and then counts as a step; whether a credential follows it as in a header."""
    low = text.lower()
    kind = key_kind(text) if cls in ("word", "str") else ""
    own = None if cls == "sep" else (cls, value_kind(text), kind, "s" if len(text) < 4 else "m" if len(text) < 8 else "l", tuple(SUBWORD.findall(low)[:4]) if kind else ())
    return low, kind, own, skipped(low), text in ("=", ":", "=>", ":=", ";", "|", "(") or low in ("is", "basic", "bearer", "with"), low.strip("'\"") in ("authorization", "by", "identified")


def token_keys(tokens: list[Token], secret_file: bool) -> list[Key]:
    """Shape and context of each token, one pass from the left and one from the right: its class, the kinds of its name and value, the nearest names before and behind
    it (what stands between a name and its value is skipped), signs beside it, and whether it is alone in a file whose name tells of a secret."""
    n = len(tokens)
    shapes = [shape(t[2], t[3]) for t in tokens]
    real = [i for i in range(n) if shapes[i][2]]
    alone, end = len(real) == 1, real[-1] if real else -1
    behind: list[str] = ["$"] * n
    right = "$"
    for i in range(n - 1, -1, -1):
        behind[i] = right
        if not shapes[i][3]:
            right = shapes[i][1]
    out: list[Key] = []
    near, hops, header, named, named_at, before = "^", 0, False, "", -16, "^"
    for i, (low, kind, own, between, step, opens) in enumerate(shapes):
        if own is None:
            out.append(("sep", low, before[:12] if i and shapes[i - 1][2] is None else shapes[i - 1][1] if i else "^"))
        else:
            after = tokens[i + 1][2] if i + 1 < n and shapes[i + 1][2] is None else "w"
            opened = header or before == "bearer" or before == "password" and i > 1 and shapes[i - 2][0] == "with"
            out.append((own, near, min(hops, 2), opened, named if i - named_at < 16 else "", behind[i], after, before == "<" and after == ">", alone, i == end, secret_file, before == "basic"))
        if kind:
            named, named_at = kind, i
        if between:
            hops += step
        else:
            near, hops, header = kind, 0, opens
        before = low
    return out


def features(key: Key) -> list[str]:
    """The binary features of a token."""
    if key[0] == "sep":
        return ["b", "c=sep", "t=" + key[1], "p=" + key[2]]
    (cls, v, kind, size, parts), near, hops, header, left, right, after, tagged, alone, last, secret_file, basic = key
    f = ["b", "c=" + cls, "v=" + v, "k=" + kind, "z=" + size, f"n={near}", f"nv={near},{v}", f"nh={near},{hops},{v}", f"hv={header},{v}", f"lv={left},{v}", f"rv={right},{v}", f"nl={near},{left},{v}", f"cv={cls},{v}", f"nz={near},{size}", f"nr={near},{right},{v}"]
    f += ["a=" + after, f"lt={tagged},{v}", f"lone={alone},{secret_file},{v}", f"last={last},{secret_file},{near},{v}", f"basic={basic},{v}", f"kn={kind},{after}"]
    return f + [f"w={p}" for p in parts]


# Made lines


def made_lines(n: int = TRAINING_LINES, seed: int = SEED) -> Iterator[tuple[str, list[tuple[int, int]], bool]]:
    """(line, spans of literal credentials, whether the file's name tells of a secret): ways in which code, configuration and prose hold a name and a
    value; the name is of a credential, of something about credentials, of an id, or plain; the value is a literal, a reference, a placeholder, an id or a word."""
    r = random.Random(seed)
    words = "amber anchor basil birch canyon cedar cobalt coral dune ember fjord garnet grove hazel indigo ivory juniper kelp linen maple nectar onyx opal pearl quill raven sable tundra umber vale willow zephyr".split()
    plain = "cache queue mode level port host region output format style retries cluster theme locale window engine widget layout color branch".split()
    cred = "password passwd passphrase passwort pwd pw pass secret api_key apikey access_token auth_token client_secret signing_secret private_token db_password admin_password root_pw smtp.pass refresh_token session_secret encryption_key secret_key deploy_token bearer _auth authorization contrasena mot_de_passe webhook_secret app_secret service_credential x_api_key keystore_password _authToken authToken token smtp_pass".split()
    label = "password_label token_type api_key_header password_reset_path passwordResetPath password_min_length secret_rotation_days token_ttl password_field tokenName".split()
    ids = "etag commit revision checksum integrity asset_uuid trace_id build_id logo icon font sha256 request_id".split()
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))

    def literal() -> str:
        w = r.choice(words)
        return r.choice(
            [
                lambda: w.capitalize() + str(r.randint(10, 1999)) + r.choice(["", "!", "?", "#", "$", "%21"]),
                lambda: f"{w}-{r.choice(words)}-{r.randint(2, 99)}{r.choice(words)}",
                lambda: w.replace("e", "3").replace("o", "0") + r.choice("!*#%&?") + r.choice(words)[:4],
                lambda: w[:3].upper() + r.choice("!_.#") + some(alnum, 7),
                lambda: some(alnum + "!%_-.+*", r.randint(9, 16)) + "7a",
                lambda: some(alnum, r.randint(16, 40)) + "4Kd",
                lambda: some(alnum + "+/", r.randint(22, 43)) + "9Xq" + r.choice(["", "="]),
                lambda: some(hexa, 31) + "7",
                lambda: w.replace("a", "4").replace("i", "1") + r.choice(words)[:5] + r.choice(["", "7"]) if set(w) & set("ai") else w + "9" + r.choice(words)[:4],
            ]
        )()

    def prefixed() -> str:
        return r.choice(
            [
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + some(alnum, 36),
                lambda: "sk_live_" + some(alnum, 24),
                lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24),
                lambda: "glpat-" + some(alnum + "_-", 20),
                lambda: "eyJ" + some(alnum, 33) + "." + some(alnum, 40) + "." + some(alnum + "-_", 43),
                lambda: "npm_" + some(alnum, 36),
                lambda: some(string.ascii_lowercase, r.randint(2, 5)) + r.choice(["_live_", "_prod_", "_test_", "-"]) + some(alnum, r.randint(18, 32)) + "7Q",
            ]
        )()

    def shaped_id() -> str:
        return r.choice([lambda: some(hexa, 39) + "1", lambda: some(hexa, 63) + "2", lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))])()

    def known_id() -> str:
        return r.choice([lambda: f"sha512-{some(alnum + '+/', 86)}==", lambda: f"data:image/png;base64,{some(alnum + '+/', 60)}", lambda: "sha256:" + some(hexa, 64)])()

    def placeholder(key: str) -> str:
        return r.choice(["changeme", "<password>", "<your-token>", "your_password_here", "TODO", "********", "xxxxxxxxxxxx", "[REDACTED]", "${" + key.upper() + "}", "{{ vault." + key + " }}", "%" + key.upper() + "%", "$" + key.upper(), "none", "%(pw)s"])

    def cased(key: str) -> str:
        return r.choice([key, key, key.upper(), regex.sub(r"_(\w)", lambda m: m[1].upper(), key), key.capitalize(), key.replace("_", ".")])

    assigned = [
        "{k} = {q}{v}{q}", "{k}={v}", "{k}: {v}", "{k}: {q}{v}{q}", '"{k}": "{v}",', "'{k}' => '{v}',", "export {k}={q}{v}{q}", "const {k} = {q}{v}{q};", "${k} = '{v}';", "{k} := \"{v}\"", "setenv('{k}={v}');", "define('{k}', '{v}');", 'env["{k}"] = {q}{v}{q}',
        "<{k}>{v}</{k}>", '<property name="{k}" value="{v}"/>', '<host id="a" {k}="{v}"/>', '{{"name": "{k}", "value": "{v}"}},', "- {k}={v}", "#{k}={v}", "// {k} used to be {v}", "# {k}: {v}", "{k}: !str {q}{v}{q}", '@Inject("{v}") String {k};', 'fallback = "{v}" # {k}',
        "public static final String {k} = \"{v}\";", "tool connect --user svc --{k} {v}", "Use `{k}` with `{v}` on the test stage.", "its {k} is {v}", "# {k} is {v}, change it", "# new {k} {v}", "const x = process.env.{k} || {q}{v}{q};", "env.{k} = env.{k} || {q}{v}{q};", "{k} = os.getenv('X', {q}{v}{q})", "connect(user='svc', {k}='{v}')", 'login = {{ user = "svc", {k} = "{v}" }}',
        '"login": {{"user": "svc", "{k}": "{v}"}},', "12;{k};{v}", "INSERT INTO options VALUES ('{k}', '{v}');", 'p.put("{k}", "{v}");', 'app.{k} = "{v}"', 'x.set{k}("{v}");', "{k}={v} ./start", '{k} = "{v}" \\', "//packages.h.test/:{k}={v}", "machine h.test login svc {k} {v}", "# it starts with {k} : {v}",
        '{{"hosts": {{"h.test": {{"{k}": "{v}"}}}}}}', "Server=h.example;User Id=svc;{k}={v}", "curl -H '{k}: {v}' https://h.test/v1", "- {k}: {v}", '{{ "a": 12, "{k}": "{v}", "b": "x" }}', "// {k} was {v} before",
    ]
    keyless = ["headers['Authorization'] = `Bearer {v}`;", 'headers["Authorization"] = "Bearer {v}"', "CREATE USER svc WITH PASSWORD '{v}';", "ALTER USER svc IDENTIFIED BY '{v}';", "curl -H 'Authorization: Bearer {v}' https://h.test"]
    prose = ["Each {p} keeps its own {w}, and the {p} setting of {w} moves to {p}.", "After the {p} ends, {p}.php may be read; {w} lists 12 entries.", "Forgot your password? Ask for a new token on the {p} page.", "# password rules: docs/{p}", "The first pass over each {p} writes {w}, the last pass emits nothing.", "A third pass drops whatever {w} kept while our {p} starts early.", "Every token of the {p} is read twice by {w}.", "It is no secret that {p} needs {w} completely.", "// auth for {p} happens in {w}, not here", "{k} = getenv('{K}');", "{k} = os.environ[\"{K}\"]", "const {k} = process.env.{K};", "String {k} = System.getenv(\"{K}\");",
             "return {p}.{w}(4711);", "import {p} from './{w}';", "function {p}(${w}) {{", '  "{p}": 512,', "{p}_enabled: true", "if not {w}:", "# mail {w}@host.example first", "// image h.test/{w}@sha256:{h}", "git clone git@h.example:core/{w}.git", "friendlyName: {w}", "Bag Attributes", "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "reads {k} from the vault", "{w}:{w}:{p}", "auth: {w}", "key: {p}-{w}", "cache key: {w}-{w}",
             "const {p} = require('{w}');", "{p}: {w}-{p}", "phone +1 212 555 0100, mail {w}@host.test", "see https://host.test/{p}/{w}?page=2", "ports 8080-8090, timeout 3600", "{P}_MODE={w}", "secret_rotation_days: 30", "token_count = 1024", "[tool.{p}]", "<{p} {w}=\"12\"/>", "{k}: str = Field(...)", "def check_{k}(value): return value",
             "INSERT INTO guests VALUES (12, 'Ann Example', '{w}@host.test', '+1 212 555 0100');", "UPDATE guests SET mail = '{w}.{w}@host.test' WHERE id = 3;", '12;"Ann Example";;"+12125550100"', '"contact": {{"mail": "{w}@host.test", "tel": "+44 20 7946 0000"}},', "ssh-ed25519 {s} {w}", "ssh-rsa {s}= {w}@host", "{h}", "{g}", "{e}", "{e}", "{e}  {w}.zip", "{h}  {w}.tar.gz", "{w} {g} {p}", "merged {g} into {p}", "[{w}](https://h.test/{p}/{g})", "v1.2.{n} {w}", "## 1.{n}.0 - 2021-0{m}-1{m}", "- {w} {p} ({n} of {n})", "| {w} | {p} | 1.{n} | yes |", "{w}.{p}({w}, {p}[{n}]) -> {w}", "'{w}/{p}': '^1.{n}.0',", "{w}@1.{n}.2:", "  resolved https://h.test/{w}/-/{w}-1.{n}.tgz#{g}", "  integrity sha512-{s}==", "| {u} | {w} |", "request {u} took {n} ms", "logo: data:image/png;base64,{s}", '12;;{w}@host.test;"{c}"', '"orderNo": "{c}",', "code '{c}' of {w}", "(3, '{w}', '{c}');", "{w}_", "{P}_", "{c}", "part {c} {w}"]
    for i in range(n):
        key = cased(r.choice(cred))
        q = r.choice("\"'`") if r.random() < 0.9 else '"'
        kind = r.random()
        good, hidden, value = False, False, ""
        if kind < 0.40:
            x = r.random()
            template = r.choice(assigned)
            if x < 0.50:
                value, good = (literal() if r.random() < 0.55 else prefixed() if r.random() < 0.55 else shaped_id()), True
            elif x < 0.58 and "options" not in template:
                basic, good = base64.b64encode(b"svc:" + literal().encode()).decode().rstrip("="), True
                value = "Basic " + basic
            elif x < 0.82:
                value = placeholder(r.choice(cred))
            elif x < 0.92:
                value = known_id()
            else:
                value = r.choice(["bearer", "Password", "X-Token", "/login/forgot", "12", "true"])
            line = template.format(k=key, v="\0", q=q)
        elif kind < 0.58:
            key = cased(r.choice(label if r.random() < 0.4 else ids if r.random() < 0.6 else plain))
            x = r.random()
            template = r.choice(assigned)
            value = (r.choice(["bearer", "Password", "X-Token", "/login/forgot", str(r.randint(1, 999))]) if x < 0.35 else shaped_id() if x < 0.6 else known_id() if x < 0.8 else r.choice(words))
            if r.random() < 0.08:
                key, value, good = r.choice(["key1", "option", "value", "x", r.choice(plain)]), prefixed(), True
            line = template.format(k=key, v="\0", q=q)
        elif kind < 0.65:
            x = r.random()
            value = literal() if x < 0.35 else prefixed() if x < 0.5 else known_id() if x < 0.7 else shaped_id() if x < 0.88 else r.choice(["/login/forgot", "bearer", "Password", "<your-token>", "${TOKEN}"])
            good = x < 0.5
            line = r.choice(keyless).format(v="\0")
        elif kind < 0.77:
            user = r.choice(["svc", "root", "app", "", "deploy"])
            good = r.random() < 0.65
            value = regex.sub(r"[/@!#?&+ ]", "%21", literal()) if good else r.choice(["<password>", "$PW", "${DB_PASS}", "****", "%(pw)s", "{{ db.pw }}", "xxxx", "password", "changeme"])
            value = value if r.random() < 0.9 or not good else r.choice(words) + r.choice(words)[:4]
            url = f"{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'smtp', 'mongodb'])}://{user}:\0@db.h.example:5432/x"
            line = r.choice([t for t in assigned if "{v}" in t and "Bearer" not in t]).format(k=cased(r.choice(["database_url", "dsn", "remote", "broker", "cache_uri", "jdbc_url", *plain])), v=url, q=q)
        elif kind < 0.81:
            hidden = True
            x = r.random()
            if x < 0.5:
                value, line, good = r.choice([literal, prefixed, shaped_id])(), "\0", True
            elif x < 0.75:
                value, line, good = literal(), f"host.example.com:5432:{r.choice(plain)}:svc:\0", True
            else:
                line = r.choice(["Bag Attributes", f"friendlyName: {r.choice(words)}", "# rotated by hand", f"machine {r.choice(words)}.test", "-----BEGIN CERTIFICATE-----"])
        elif kind < 0.84:
            value, good = r.choice(["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN ENCRYPTED PRIVATE KEY-----"]), True
            line = r.choice(["\0", "  \0", "PRIVATE_KEY=\0\\nMIIab", 'key: "\0\\nMIIab"', "# \0"])
        elif kind < 0.865:
            value, good = prefixed(), True
            line = r.choice(["\0", "# \0", "tried \0 for a while", "  \0,", "<x1>\0</x1>", "{q}\0{q},".format(q="'")])
        else:
            p = r.choice(plain)
            line = r.choice(prose).format(p=p, P=p.upper(), w=r.choice(words), k=key, K=key.upper(), h=some(hexa, 64), g=some(hexa, 40), e=some(hexa, 32), s="AAAA" + some(alnum + "+/", 64), n=r.randint(1, 99), m=r.randint(1, 9), u="-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), c=some(string.ascii_uppercase, r.randint(1, 3)) + some(string.digits, r.randint(4, 9)) + r.choice(["", some(string.ascii_uppercase, 1)]))
        at = line.find("\0")
        line = line.replace("\0", value)
        if good and value.startswith("Basic "):
            at, value = at + 6, value[6:]
        yield line, [(at, at + len(value))] if good else [], hidden


def gold_labels(tokens: list[Token], spans: list[tuple[int, int]]) -> list[int]:
    """V inside a span; K for the nearest credential name before it (or after, where none is before), C between."""
    labels = [V if any(a < e and b > s for s, e in spans) and c != "sep" else O for a, b, _, c in tokens]
    hits = [i for i, x in enumerate(labels) if x == V]
    if hits:
        names = [i for i in range(len(tokens)) if tokens[i][3] in ("word", "str") and labels[i] == O and key_kind(tokens[i][2]) == "cred"]
        before = [i for i in names if i < hits[0]]
        if before:
            labels[before[-1]] = K
            for i in range(before[-1] + 1, hits[0]):
                labels[i] = C
        elif names:
            labels[names[0]] = K
    return labels


@lru_cache(maxsize=1)
def fitted(n: int = TRAINING_LINES, seed: int = SEED) -> LinearChain:
    lines, labels = [], []
    for line, spans, hidden in made_lines(n, seed):
        tokens = lex(line)
        if tokens:
            lines.append([features(k) for k in token_keys(tokens, hidden)])
            labels.append(gold_labels(tokens, spans))
    return LinearChain(LABELS).fit(lines, labels)


# Texts

#: Lines whose spans a task keeps, and their length at most: files repeat their lines.
LINES_KEPT, LINE_KEPT = 50_000, 400
BLOCK = regex.compile(r"-{5}BEGIN [A-Z0-9 ]*-{5}")
#: Lines of a block: base64, alone or as a comment or string; headers; nothing.
BODY_LINE = regex.compile(r"""\s*(?:(?:\#+|//+|\*|;|--|>|\|)\s+|[#;*])?(?:[+.]\s+)?["'`]?(?P<core>=?[A-Za-z0-9+/]+={0,2})(?:\\[rn])*["'`]?\s*(?:[+.\\]|[,;)\]]+)?\s*""")
BODY_HEADER = regex.compile(r"""[\s#/*;"'`]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):\s""")
BODY_EMPTY = regex.compile(r"""[\s#/*;"'`]*""")
#: Only the last line of a body is shorter.
LEAST_BODY = 16
LITERAL = regex.compile(r"""(?P<q>["'`])(?P<in>(?:\\.|(?!(?P=q)).)*)(?P=q)""")
MARK = r"(?:\#+|//+|--|;|\*(?!\*))"
#: The end of a line after the closing quote of a literal that goes on, and the start of the line with its next part.
GOES_ON = regex.compile(r"""(?P<q>["'`])\s*(?P<op>\.\.|[+.&\\])?\s*\\?\s*(?:(?:\#|//)[^"'`]*)?$""")
NEXT_PART = regex.compile(rf"""\s*(?P<mark>{MARK}\s*)?(?P<op>\.\.|[+.&])?\s*(?:[rbfuRBFU]{{1,2}}|[@$L])?(?P<q>["'`])(?P<in>(?:\\.|(?!(?P=q)).)*)(?P<close>(?P=q))?""")
#: What a literal that may go on without a sign stands behind; not the value of a command's option.
ASSIGNED = regex.compile(r"(?:^|(?<!(?:^|\s)--?[\w-]+)[=:]|=>|[(,+.&\[{]|\breturn)\s*(?:[rbfuRBFU]{1,2}|[@$L])?$")
ALONE = regex.compile(r"\s*(?:[+.&\\]|\.\.)?[)\]};,\s]*(?:(?:\#|//).*)?$")
#: A value that begins on the next line.
AWAITS = regex.compile(r"(?:(?<![=!<>])=>?|:=?|(?:[=:]|\w)\s*\()\s*\\?\s*$")
OPEN_TEXT = regex.compile(r"""(?:^|[\s=:(,>])["'`](?:[^"'`\s\\]|\\.)*\\\s*$""")
BARE_TEXT = regex.compile(r"[=:]\s*[^\s\"'`\\;,&|(){}]{4,}\\$")
ASSIGNMENT = regex.compile(r"\s*[\w.-]+\s*[=:]")
LAST_SIGNS, FIRST_SIGNS = frozenset("\"'`+.&\\=(:>"), frozenset("\"'`+.&#/*-;rbfuRBFUL@$")


def joint(text: str, line: str, last: bool, indent: int, properties: bool) -> tuple[int, int, str] | None:
    """Where a string literal of `text` goes on in `line`: the characters of `text` before the joint, those of `line` to leave out, and the quote that the whole literal
    began with; nothing where none goes on. `last`: `line` is the file's last, which may be cut off inside the literal."""
    end = text.rstrip()
    if not end or not line or line.isspace():
        return None
    if end[-1] == "\\":
        blanks = len(line) - len(line.lstrip())
        rest = LITERAL.sub(lambda m: "_" * len(m.group()), end)
        if OPEN_TEXT.search(rest) or BARE_TEXT.search(rest) and (properties or not blanks) and not ASSIGNMENT.match(line):
            return len(end) - 1, blanks, ""
    tail = end[-1] in LAST_SIGNS or "#" in end or "//" in end
    if not tail or line.lstrip()[0] not in FIRST_SIGNS:
        return None
    part = NEXT_PART.match(line)
    if not part or not part["close"] and not last or part["mark"] and not regex.match(r"\s*" + MARK, text):
        return None
    after = line[part.end() :]
    goes = GOES_ON.search(end)
    if goes:
        whole = next((m for m in LITERAL.finditer(end) if m.end() - 1 == goes.start()), None)
        if whole is None or regex.match(r"\s*[=:](?!=)", after):
            return None
        before = end[: whole.start()].rstrip()
        sign = goes["op"] or part["op"]
        if sign == "+" or ASSIGNED.search(before) and (sign or ALONE.match(after) and (len(line) - len(line.lstrip()) > indent or sum(map(before.count, "([{")) > sum(map(before.count, ")]}")))):
            return goes.start(), part.start("in"), whole["q"]
        return None
    if AWAITS.search(end) and not part["op"] and ALONE.match(after):
        return len(end.rstrip("\\").rstrip()), part.start("q"), ""
    return None


def joined(lines: list[str], starts: list[int], k: int, properties: bool) -> tuple[str, list[tuple[int, int, int]], int]:
    """Line k and the lines that its string literals go on in as one text without quotes and signs between the parts; (start in that text, start in the
    file, characters) of each part; the number of lines."""
    text, parts, n = lines[k], [(0, starts[k], len(lines[k]))], 1
    indent = len(text) - len(text.lstrip())
    while k + n < len(lines):
        line = lines[k + n]
        at = joint(text, line, k + n == len(lines) - 1, indent, properties)
        if at is None:
            break
        keep, skip, quote = at
        rest = line[skip:]
        if quote and (q := line[skip - 1]) != quote:
            m = regex.match(rf"((?:\\.|[^{q}])*){q}", rest)
            rest = m[1].replace(quote, "^") + quote + rest[m.end() :] if m else rest.replace(quote, "^")
        a, b, _ = parts[-1]
        parts[-1] = (a, b, keep - a)
        parts.append((keep, starts[k + n] + skip, len(rest)))
        text = text[:keep] + rest
        n += 1
    return text, parts, n


def with_parts(spans: list[tuple[int, int]], whole: str, parts: list[tuple[int, int, int]], lines: list[str], starts: list[int], label: Callable[[str], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """`spans` of the joined text `whole` and those that only show where its lines are labelled alone (a whole literal may look like an id, its part not), then of
    the whole literal."""
    out = list(spans)
    for line, start in zip(lines, starts):
        for a, b in label(line):
            for at, real, size in parts:
                x, y = max(start + a, real), min(start + b, real + size)
                if x >= y:
                    continue
                x, y = x - real + at, y - real + at
                literal = next((m for m in LITERAL.finditer(whole) if m.start("in") <= x and y <= m.end("in")), None)
                if literal and any(literal.start("in") < joint < literal.end("in") for joint, _, _ in parts[1:]):
                    x, y = literal.span("in")
                if not any(x < d and y > c for c, d in out):
                    out.append((x, y))
    return sorted(out)


def block_end(lines: list[str], k: int) -> int:
    """The line after the block of a key or certificate whose body would begin at line k: after its END line or, where that is cut off, after its last line of
    base64; such lines are equally long but for the last, and nothing else nor an empty line lies between."""
    for j in range(k, len(lines)):
        if "-----END" in lines[j]:
            return j + 1
        if not (BODY_LINE.fullmatch(lines[j]) or BODY_HEADER.match(lines[j]) or BODY_EMPTY.fullmatch(lines[j])):
            break
    j = k
    while j < len(lines) and BODY_HEADER.match(lines[j]):
        j += 1
    if j < len(lines) and BODY_EMPTY.fullmatch(lines[j]):
        j += 1
    size, end = 0, k
    while j < len(lines) and (m := BODY_LINE.fullmatch(lines[j])):
        own = len(m["core"])
        if own != size and (own > size > 0 or own < LEAST_BODY and (not size or own % 4) and j < len(lines) - 1):
            break
        j = end = j + 1
        if size and own < size:
            break
        size = own
    return end


def find_credentials(model: LinearChain, name: str | None, text: str | None, seen: dict | None = None) -> list[tuple[int, int, int]]:
    """(start, end, line number from 1) of each literal credential of a file; none for null and empty texts. `seen` keeps the
    spans of short lines met before. A literal that goes on in following lines (behind a backslash, beside + or . or &, or next to the next string) is labelled as one text and
    gives a span for each of its parts, all with the number of the line that it starts on.

    Every line is labelled, whole at any length. The body of a key or certificate block is passed over (see `block_end`); a private key's span runs to its END line
    or, where that is cut off, to the last line of key characters.
    """
    if not text:
        return []
    seen = {} if seen is None else seen
    secret_file = bool(name and SECRET_FILE.search(name))
    properties = bool(name and name.endswith(".properties"))
    lines = text.split("\n")
    starts = [0, *accumulate(len(line) + 1 for line in lines[:-1])]
    out, k = [], 0
    while k < len(lines):
        whole, parts, n = joined(lines, starts, k, properties)
        k += n
        key = (secret_file, whole if n == 1 else tuple(lines[k - n : k]))
        spans = seen.get(key)
        if spans is None:
            spans = line_spans(model, whole, secret_file)
            if n > 1:
                spans = with_parts(spans, whole, parts, lines[k - n : k], starts[k - n : k], lambda line: line_spans(model, line, secret_file))
            if len(whole) <= LINE_KEPT:
                if len(seen) >= LINES_KEPT:
                    seen.clear()
                seen[key] = spans
        block = BLOCK.search(whole)
        cut_off = block and "-----END" not in whole[block.end() :]
        after = block_end(lines, k) if cut_off else k
        last = next((i for i in range(after - 1, k - 1, -1) if lines[i].strip()), None)
        for a, b in spans:
            own = [(real + max(a - at, 0), real + min(b - at, size)) for at, real, size in parts if a < at + size and b > at]
            number = bisect_right(starts, own[0][0])
            out += [(x, y, number) for x, y in own]
            if cut_off and a == block.start() and last is not None:
                out[-1] = (out[-1][0], starts[last] + len(lines[last].rstrip()), number)
        k = after
    return out


def line_spans(model: LinearChain, line: str, secret_file: bool) -> list[tuple[int, int]]:
    """The literal tokens of a line, of any length, on the likeliest path of labels."""
    tokens = lex(line)
    spans: list[tuple[int, int]] = []
    if not tokens:
        return spans
    labels = model.labelled(token_keys(tokens, secret_file), features)
    for (a, b, text, cls), label in zip(tokens, labels) if labels else ():
        if label == V and cls != "sep":
            if cls == "pem" or text.startswith("-----BEGIN"):
                end = line.find("-----END", a)
                b = b if end < 0 else line.find("-----", end + 8) + 5 if line.find("-----", end + 8) > 0 else len(line.rstrip())
            if not spans or a >= spans[-1][1]:
                spans.append((a, b))
    return spans


def credentials(df: DataFrame, row_id: str = "file_id", name: str = "name", content: str = "content") -> DataFrame:
    """Rows (row_id, line_no, start, end) of every literal credential; offsets are code points into the text; a literal that goes on in following lines gives a row
    for each part, with the line_no of its first. Null and empty texts give no rows, a null name counts as an ordinary file; other columns are not read; a repeated row gives its own again. No shuffle."""
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            rows = [(i, n, a, b) for i, f, text in zip(*(batch.column(c).to_pylist() for c in range(3))) for a, b, n in find_credentials(model, f, text, seen)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))], names=["id", "line_no", "start", "end"])

    kind = dict(df.dtypes)[row_id]
    return df.select(F.col(row_id), F.col(name).cast("string"), F.col(content).cast("string")).mapInArrow(run, f"id {kind}, line_no bigint, start bigint, end bigint").withColumnRenamed("id", row_id)


def redact_credentials(df: DataFrame, name: str = "name", content: str = "content", mark: str = "[REDACTED]") -> DataFrame:
    """`df` with exactly the characters of each credential in `content` replaced by `mark`; quotes, separators and all other text stay."""
    model = fitted()

    seen: dict = {}

    def cut(names, texts):
        out = []
        for n, text in zip(names, texts):
            last, parts = 0, []
            for a, b, _ in find_credentials(model, n, text, seen):
                parts += [text[last:a], mark]
                last = b
            out.append("".join(parts) + text[last:] if text else text)
        return texts.__class__(out, index=texts.index, dtype=object)

    return df.withColumn(content, F.pandas_udf(cut, "string")(F.col(name), F.col(content)))
