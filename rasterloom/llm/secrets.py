"""Secret scan: patterns propose candidates, a random forest removes false positives.

Candidates are values given to a telling name (``token = "..."``; quoted ones may hold spaces),
what follows ``Bearer`` or stands as the password of an address, keys with a known prefix or
frame, and long unbroken runs that hold digits.  A name tells by whole words of it: ``auth_token``
does, ``author`` doesn't.  The forest sees a candidate's length, character transitions, dictionary
coverage, whether it lies in a path or address, how it was given, the words beside it, and what
the whole unbroken token around it shows (a digest in a path, a date, a DOI, a public key's or
certificate's frame, a data URI).  It is grown on labelled findings: invented lines with
real-looking secrets and with what is mistaken for them (digests of commits and files, public
keys, data URIs, identifiers, time stamps, paths, placeholders, prose after a colon, card and
phone numbers).

Whole texts and whole values are read where they lie, in time proportional to the text, no
shuffle.  All candidates are scored first: of overlapping ones those taken for secrets win, then
keys of a known form, then the earliest, then the longest.  Null or empty texts give no findings;
repeated rows give their findings each; an empty table gives none.  Offsets count code points.
Other columns may have any name: ``scan`` reads the id and the text only, ``masked`` leaves the
others as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, prepare
from .trees import Forest, grow_forest

# Words of names that are given secrets, words that tell of digests and samples.
_PASSWORDS = frozenset("password passwd passphrase pwd pass passcode pw".split())
_TOKENS = frozenset("token secret apikey credential auth authorization authtoken accesskey secretkey privatekey".split())
_KEY_OF = frozenset("api access private secret client signing encryption account storage master".split())
_BENIGN = frozenset("commit sha sha1 sha256 md5 checksum digest hash etag revision rev uuid guid id build version file path image blob tree isbn order invoice phone card".split())
_SAMPLE = re.compile(r"example|sample|dummy|placeholder|your|changeme|change_me|xxxx|\*\*\*|test|todo|redacted|none|null|<|\$\{|\(|\[|1234|abcd|(.)\1{5,}", re.I)
#: Fixed key formats.
_PREFIXED = re.compile(
    r"-----BEGIN [A-Z ]*+PRIVATE KEY-----|-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"
    r"|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+)"
)
_MARKS = ("-----BEGIN", "AKIA", "ASIA", "gh", "glpat-", "sk_", "xox", "AIza", "eyJ")
_FRAME = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nr])*+-----END [A-Z ]{0,30}-----")
#: A name (read once: possessive) and what gives it a value.
_NAME = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)[\"']?\s{0,3}(=>|:=|==|[:=])\s{0,3}")
_VALUE = re.compile(r"\"([^\"\n]{6,}+)\"|'([^'\n]{6,}+)'|[\"']?((?:[^\s\"'<>;,&]|&(?![A-Za-z0-9_-]{1,40}=)){6,}+)")
_BEARER = re.compile(r"\b(?:[Bb]earer|[Bb]asic)\s{1,3}([A-Za-z0-9._~+/=-]{16,}+)")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"'<>]{1,200}:([^\s:/@\"'<>]{4,200})@")
_LONG = 18
_RUN = re.compile(r"[A-Za-z0-9+/_-]{18,}+={0,2}")
_DIGIT = re.compile(r"[0-9]")
# What stands before or around public values.  Fixed values.
_PUBLIC_KEY = re.compile(r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp\d{3}|sk-(?:ssh|ecdsa)-[\w.@-]{1,60})\s{1,3}$")
_BASE64_URI = re.compile(r"data:[\w.+-]{0,40}/?[\w.+-]{0,40}(?:;[\w=.-]{1,40}){0,3};base64,$")
_DIGEST = re.compile(r"(?:^|[^0-9A-Za-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})(?![0-9A-Za-z])", re.I)
_DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}[-/]?[01][0-9][-/]?[0-3][0-9]")
_DOI = re.compile(r"(?:^|[/:\s(])10\.[0-9]{4,9}/")
_NAMED_DIGEST = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|blake2[bs]?|integrity|fingerprint|btih)[\"']?[-:= ]{1,3}[\"']?$", re.I)
_BLOCK_LABEL = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
#: How far back a frame that a value lies in may begin: that of a large certificate.
_FRAME_REACH = 16_384
_KINDS = ("prefixed", "bearer", "address", "given", "run")

_DICTIONARY = "the and for with from this that have not are was has you all one when more time user name value key file image data test path index config service system local server client public private http https www com org net html example default null true false string number list item main page link order number street road city river water history people world house first last great small never under after before about where which their other und der die das nicht auch eine ist von mit les des une est dans pour que qui los las una por con para".split()


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    name: int = 0  # 1: a token's name, 2: a password's
    equals: bool = False
    quoted: bool = False
    code: bool = False  # the name is written as in code


@cache
def _plain_words(name: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[_-]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if w)


def told_by(name: str) -> int:
    """2 if whole words of the name tell of a password, 1 of another secret, else 0."""
    if len(name) > 100:
        return 0
    words = _plain_words(name) if len(name) <= 40 else _plain_words.__wrapped__(name)
    if any(w in _PASSWORDS for w in words):
        return 2
    pairs = zip(words, words[1:], strict=False)
    return int(any(w in _TOKENS for w in words) or any(b == "key" and a in _KEY_OF for a, b in pairs))


def candidates(text: str) -> list[Candidate]:
    """Every candidate, overlaps included, in the order of the patterns."""
    found: list[Candidate] = []
    if "=" in text or ":" in text:
        at = 0
        while m := _NAME.search(text, at):
            at = m.end()
            told = told_by(m.group(1))
            value = _VALUE.match(text, at) if told else None
            if value is None:
                continue
            at = value.end()  # what stands in a value is part of it
            group = value.lastindex
            start, end = value.span(group)
            if group == 3:
                while end > start and text[end - 1] in ".)]}:":
                    end -= 1
            if end - start >= 6:
                name = m.group(1)
                code = "_" in name or "-" in name or name.isupper() or not (name.islower() or name.istitle())
                found.append(Candidate(start, end, "given", told, m.group(2) != ":", group < 3, code))
        if "earer" in text or "asic " in text:
            found += [Candidate(*m.span(1), "bearer") for m in _BEARER.finditer(text)]
        if "://" in text and "@" in text:
            found += [Candidate(*m.span(1), "address") for m in _ADDRESS.finditer(text)]
    if any(m in text for m in _MARKS):
        for m in _PREFIXED.finditer(text):
            rest = _FRAME.match(text, m.end()) if m.group().startswith("-----") else None
            found.append(Candidate(m.start(), rest.end() if rest else m.end(), "prefixed"))
    if any(len(w) >= _LONG and _DIGIT.search(w) for w in text.split()):
        found += [Candidate(*m.span(), "run") for m in _RUN.finditer(text) if _DIGIT.search(m.group())]
    return found


@cache
def _transitions() -> dict[str, float]:
    """Log-likelihood of a letter after a letter in the dictionary's words, add-one smoothed."""
    pairs = Counter(a + b for w in _DICTIONARY for a, b in zip("^" + w, w, strict=False))
    firsts = Counter(p[0] for p in pairs.elements())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: math.log((pairs[a + b] + 1) / (firsts[a] + 26)) for a in "^" + letters for b in letters}


@cache
def _words_pattern() -> re.Pattern:
    return re.compile("|".join(sorted((w for w in _DICTIONARY if len(w) > 2), key=len, reverse=True)))


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "p"


def _in_public_frame(text: str, at: int) -> bool:
    """Whether the last frame begun before is open and isn't a private key's."""
    begun = text.rfind("-----BEGIN ", max(0, at - _FRAME_REACH), at)
    if begun < 0 or text.find("-----END ", begun, at) >= 0:
        return False
    label = _BLOCK_LABEL.match(text, begun)
    return bool(label) and "PRIVATE" not in label.group(1)


def _token_around(text: str, c: Candidate) -> tuple[str, str]:
    """What stands before and after the candidate in the same unbroken run of text (300 characters each way)."""
    before = re.split(r"[\s\"'<>]", text[max(0, c.start - 300) : c.start])[-1]
    return before, re.split(r"[\s\"'<>]", text[c.end : c.end + 300])[0]


def candidate_features(text: str, c: Candidate) -> tuple:
    value = text[c.start : c.end]
    low = value.lower()
    before, after = text[max(0, c.start - 60) : c.start], text[c.end : c.end + 40]
    around = re.findall(r"[a-z0-9_]+", before.lower())[-4:] + re.findall(r"[a-z0-9_]+", after.lower())[:2]
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    table = _transitions()
    steps = [table[p] for p in (a + b for a, b in zip(low, low[1:], strict=False)) if p in table]
    classes = "".join(map(_class, value))
    token = re.split(r"[\s\"']", before)[-1] if before else ""
    left, right = _token_around(text, c)
    whole = f"{left}{value[:1000]}{right}"
    return (
        float(n),
        entropy,
        sum(steps) / len(steps) if steps else -4.0,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        classes.count("d") / n,
        classes.count("u") / n,
        classes.count("p") / n,
        sum(map(len, _words_pattern().findall(low))) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(value.isdigit()),
        float(value.count("/") + value.count("\\")) / n,
        float("://" in token or "/" in token or "@" in token or before.endswith((".", "/"))),
        float(c.name),
        float(any(w in _BENIGN for w in around)),
        float(bool(_SAMPLE.search(value))),
        float(value.count("_") + value.count("-")) / n,
        float(c.equals),
        float(c.quoted),
        float(c.code),
        float(value.count(" ")),
        float(value.isalpha()),
        *(float(c.kind == k) for k in _KINDS),
        float(bool(_PUBLIC_KEY.search(before)) or _in_public_frame(text, c.start)),
        float(bool(_BASE64_URI.search(left[-140:] if left else before[-60:]))),
        float("://" in whole),
        float(bool(_DIGEST.search(whole))),
        float(bool(_DATE.search(whole))),
        float(bool(_DOI.search(whole))),
        float(bool(_NAMED_DIGEST.search(before)) or value[:2] == "0x"),
        float(len(left) + len(right)),
        float(max(map(len, re.findall(r"[A-Za-z0-9+]+", value)), default=0)),  # its longest piece without a separator
    )


def labelled_findings(count: int = 6_000, seed: int = 3) -> Iterator[tuple[str, str, int]]:
    """(line, value, label): half secrets, half what is mistaken for them."""
    rng = np.random.default_rng(seed)

    def pick(seq):
        return seq[int(rng.integers(len(seq)))]

    def chars(alphabet: str, low: int, high: int | None = None) -> str:
        n = int(rng.integers(low, (high or low) + 1))
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def words(n: int, sep: str = " ") -> str:
        return sep.join(pick(_DICTIONARY) for _ in range(n))

    def invented(n: int) -> str:
        """Words of no dictionary, of consonants and vowels in turn."""
        return " ".join("".join(pick("bcdfghklmnprstvw") + pick("aeiou") for _ in range(int(rng.integers(2, 5)))) + pick(["", "n", "r", "s"]) for _ in range(n))

    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    passwords = ("password", "passwd", "pwd", "db_password", "Password", "DB_PASSWORD", "PASSPHRASE", "userPassword", "pass")
    tokens = ("token", "secret", "api_key", "apikey", "access_key", "client_secret", "auth_token", "TOKEN", "API_KEY", "apiKey", "access-token", "SECRET_KEY", "x-api-key")
    for i in range(count):
        left, right = words(int(rng.integers(0, 9))), words(int(rng.integers(0, 9)))
        if rng.random() < 0.5:
            left, right = invented(int(rng.integers(0, 9))), invented(int(rng.integers(0, 9)))
        sep, quote = pick(["=", " = ", ": ", ":", " := "]), pick(['"', '"', "'", ""])
        if i % 2 == 0:
            shape = int(rng.integers(14))
            value = (
                lambda: chars(hexa, 16, 64),
                lambda: chars(alnum, 12, 44),
                lambda: "AKIA" + chars(alnum[:26] + "0123456789", 16),
                lambda: "ghp_" + chars(alnum, 36),
                lambda: "sk_live_" + chars(alnum, 24),
                lambda: "AIza" + chars(alnum + "_-", 35),
                lambda: chars(hexa, 18),
                lambda: chars(hexa, 40),
                lambda: chars(alnum + "!@%^*", 8, 16),
                lambda: f"-----BEGIN {pick(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\\n{chars(alnum + '+/', 40, 400)}\\n-----END PRIVATE KEY-----",
                lambda: chars(alnum + "-._", 20, 60),
                lambda: pick([invented, words])(int(rng.integers(2, 6))),
                lambda: chars(alnum + "!$%^&*", 6, 20),
                lambda: words(1) + chars("0123456789!", 2, 5),
            )[shape]()
            if shape == 10:
                line = f"{left} {pick(['Authorization: Bearer', 'bearer', 'Authorization: Basic'])} {value} {right}"
            elif shape == 11:
                line = f"{left} {pick(passwords)}{pick(['=', ' = ', ': '])}\"{value}\" {right}"
            elif shape == 12:
                line = f"{left} {pick(['postgres', 'mysql', 'https', 'amqp'])}://{words(1)}:{value}@{words(1)}.example.com/{words(1)} {right}"
            elif shape == 9 or (2 <= shape <= 5 and rng.random() < 0.6):
                line = f"{left} {value} {right}"
            else:
                line = f"{left} {pick(passwords if shape in (8, 13) else tokens + passwords)}{sep}{quote}{value}{quote} {right}"
            yield line, value, 1
        else:
            shape = int(rng.integers(30))
            site = f"https://{pick(['', 'www.', 'git.', 'docs.', 'cdn.', 'api.'])}{pick([words(1, ''), invented(1)])}.{pick(['com', 'org', 'net', 'io', 'de', 'example.com'])}"
            year = f"20{chars('0123456789', 2)}-{pick(['01', '04', '09', '11'])}-{pick(['03', '15', '22', '28'])}"
            value = (
                lambda: chars(hexa, 40),
                lambda: chars(hexa, 32),
                lambda: chars(hexa, 64),
                lambda: f"{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}",
                lambda: words(4, "_") + chars("0123456789", 1, 3),
                lambda: words(3, "-") + "-" + chars("0123456789", 2, 8),
                lambda: words(3, "/") + "/" + chars("0123456789", 2, 5),
                lambda: chars("0123456789", 18, 24),
                lambda: pick(["your_token_here", "changeme", "example123", "xxxxxxxx", "${SECRET}", "********", "placeholder_value_1", "test1234test1234test", "<token>", "None", "null-null-null", "get_token()", "os.environ[KEY]", "REDACTED"]),
                lambda: words(3, "") + chars("0123456789", 1, 2),
                lambda: invented(1),
                lambda: words(1) + words(1),
                lambda: invented(1).capitalize(),
                lambda: invented(1) + ",",
                lambda: words(1, "") + "string",
                lambda: f"https://{words(1)}.example.com/{words(2, '/')}",
                lambda: f"{site}/{invented(1)}/{invented(1)}/{pick(['commit', 'blob', 'tree', 'raw', 'commits', 'archive', 'releases'])}/{chars(hexa, 40)}{pick(['', '', '/' + words(2, '/') + '.py', '.zip', '#L' + chars('0123456789', 2)])}",
                lambda: f"{site}/{words(int(rng.integers(1, 4)), '/')}/{pick([chars(hexa, 32), chars(hexa, 64), chars(alnum, 11), chars(alnum, 22), chars('0123456789', 8, 16), f'{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}'])}{pick(['', '.jpg', '/', '.html', '?page=2', '.js', '?v=' + chars(alnum, 11) + '&list=' + chars(alnum + '-', 18, 34), '?id=' + chars(alnum, 20)])}",
                lambda: f"{pick(['ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQ', 'ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAI', 'ecdsa-sha2-nistp256 AAAAE2VjZHNhLXNoYTItbmlzdHAyNTYAAAAIbmlzdHAyNTYAAABB'])}{chars(alnum + '+/', 40, 400)}{pick(['', '=', '=='])} {words(1)}@{words(1)}",
                lambda: f"data:{pick(['image/png', 'image/jpeg', 'image/svg+xml', 'font/woff2', 'application/pdf', 'text/plain;charset=utf-8'])};base64,{pick(['iVBORw0KGgo', '/9j/4AAQSkZJRg', 'PHN2Zy', 'd09GMgAB', 'JVBERi0x', ''])}{chars(alnum + '+/', 40, 600)}{pick(['', '=', '=='])}",
                lambda: f"{pick(['doi ', 'doi:', 'https://doi.org/', 'DOI: '])}10.{chars('0123456789', 4, 5)}/{pick([f'{words(1)}.{year[:4]}.{chars("0123456789", 5, 9)}', f's{chars("0123456789", 5)}-{chars("0123456789", 3)}-{chars("0123456789", 5)}-{chars(alnum, 1)}', f'{words(1)}-{chars("0123456789", 6, 12)}'])}",
                lambda: f"{year}{pick(['T', '_', '-'])}{chars('012', 1)}{chars('0123456789', 1)}{pick([':', '-', ''])}{chars('012345', 1)}{chars('0123456789', 1)}{pick([':', '-', ''])}{chars('012345', 1)}{chars('0123456789', 1)}{pick(['Z', '+00:00', '.' + chars('0123456789', 3) + 'Z', '-build-' + year.replace('-', '') + chars('0123456789', 1, 6), '-' + words(2, '-') + '-' + chars('0123456789', 2, 5)])}",
                lambda: f"{words(int(rng.integers(1, 3)), '-')}-{pick(['build', 'release', 'v', 'backup', 'log', 'snapshot'])}-{year.replace('-', '')}{pick(['', '-', '_'])}{chars('0123456789', 2, 8)}{pick(['', '.tar.gz', '.log', '-amd64'])}",
                lambda: f"{pick(['sha256', 'sha512', 'sha384', 'sha1'])}{pick(['-', ':'])}{pick([chars(hexa, 64), chars(hexa, 40), chars(alnum + '+/', 43) + '=', chars(alnum + '+/', 86) + '=='])}",
                lambda: f"{pick(['-----BEGIN PUBLIC KEY-----', '-----BEGIN CERTIFICATE-----', '-----BEGIN RSA PUBLIC KEY-----', '-----BEGIN PGP SIGNATURE-----'])}\n" + "\n".join(pick(["MII", ""]) + chars(alnum + "+/", 60) for _ in range(int(rng.integers(1, 4)))) + "\n-----END -----",
                lambda: f"{pick(['magnet:?xt=urn:btih:', 'urn:uuid:', 'urn:isbn:', 'ipfs://', 'pkg:', '0x', '0x'])}{pick([chars(hexa, 40), chars(hexa + 'ABCDEF', 40), chars('0123456789ABCDEF', 64), chars(alnum, 46), chars('0123456789', 13)])}",
                lambda: "0x" + pick([chars(hexa, 40), chars(hexa + "ABCDEF", 40), chars("0123456789ABCDEF", 16, 64)]),
                lambda: f"{pick(['magnet:?xt=urn:btih:', 'urn:sha1:', 'sha1:', 'md5:', 'fingerprint '])}{pick([chars(hexa, 40), chars(hexa, 32), chars('0123456789ABCDEF', 40)])}",
                lambda: f"{words(1)}.{chars(hexa, 16, 32)}.{pick(['js', 'css', 'png', 'woff2', 'chunk.js'])}",
                lambda: f"{pick(['/', './', 'src/', 'C:/', '../'])}{words(int(rng.integers(2, 6)), '/')}/{words(1)}{chars('0123456789', 1, 8)}.{pick(['py', 'txt', 'jpg', 'c'])}",
            )[shape]()
            name = pick(["commit", "sha1", "md5", "checksum", "digest", "etag", "revision", "build", "file", "uuid", "id", "blob", "image", "path", "see", "order"])
            if shape == 8:
                line = f"{left} {pick(tokens + passwords)}{sep}{quote}{value}{quote} {right}"
            elif shape == 6:
                line = f"{left} https://www.example.com/{value} {right}"
            elif shape in (10, 11, 12, 13):  # prose after a colon
                line = f"{left} {pick(['secret', 'password', 'token', 'the secret', 'pass', 'Password', 'auth', 'Secret'])}: {value} {right}"
            elif shape >= 16:
                cover = pick(["{}", "{}", "({})", "<{}>", '"{}"', "see {}", "{}.", "[{}]", "url: {}", "href='{}'"])
                line = f"{left} {cover.format(value)} {right}"
            elif shape in (14, 15):
                line = f"{left} {pick(tokens + passwords)}{pick([': ', '=', ' = '])}{value} {right}"
            else:
                line = f"{left} {name}{pick([' ', ': ', '=', ' '])}{value} {right}"
            yield line, value, 0


@cache
def false_positive_forest() -> Forest:
    """The forest, grown on the labelled findings; the same on every machine."""
    x, y = [], []
    for line, value, label in labelled_findings():
        for c in candidates(line):
            inside = line[c.start : c.end] in value or value in line[c.start : c.end]
            if inside:
                x.append(candidate_features(line, c))
                y.append(float(label))
    return grow_forest(np.array(x), np.array(y))


def findings(text: str | None, forest: Forest | None = None, threshold: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) without overlaps, in order; score is the share of trees' vote for a secret."""
    if not text:
        return []
    found = candidates(text)
    if not found:
        return []
    forest = forest or false_positive_forest()
    scored = [(c, forest.score(candidate_features(text, c))) for c in dict.fromkeys(found)]
    scored.sort(key=lambda s: (s[1] < threshold, s[0].kind != "prefixed", s[0].start, -s[0].end, _KINDS.index(s[0].kind)))
    starts: list[int] = []
    out: list[tuple[int, int, str, float]] = []
    for c, score in scored:
        place = bisect(starts, c.start)
        if (place == 0 or out[place - 1][1] <= c.start) and (place == len(out) or out[place][0] >= c.end):
            starts.insert(place, c.start)
            out.insert(place, (c.start, c.end, c.kind, score))
    return out


def mask(text: str | None, forest: Forest | None = None, threshold: float = 0.5, cover: str = "[SECRET]") -> str | None:
    out, at = [], 0
    for a, b, _, score in findings(text, forest, threshold):
        if score >= threshold:
            out += [text[at:a], cover]
            at = b
    return "".join(out) + text[at:] if out else text


_FINDINGS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per candidate: doc_id, start, stop, kind, value, score, is_secret."""
    prepare(documents.sparkSession)
    forest = false_positive_forest()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for a, b, kind, score in findings(text, forest, threshold):
                    rows.append({"doc_id": doc_id, "start": a, "stop": b, "kind": kind, "value": text[a:b], "score": score, "is_secret": score >= threshold})
            yield pa.RecordBatch.from_pylist(rows, schema=_FINDINGS)

    return as_text(documents, id_col, text_col).mapInArrow(found, "doc_id long, start long, stop long, kind string, value string, score double, is_secret boolean")


def masked(documents: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """Every row with its secrets covered; ``length_col``, where there is one, follows a changed text."""
    prepare(documents.sparkSession)
    forest, at = false_positive_forest(), documents.columns.index(text_col)
    counted = documents.columns.index(length_col) if length_col in documents.columns else None

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [mask(t, forest, threshold) for t in old]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if counted is not None:
                sizes = [n if a is b or a == b else len(b) for n, a, b in zip(columns[counted].to_pylist(), old, new, strict=True)]
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(cover, documents.schema)
