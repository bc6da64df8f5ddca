"""PII surrogates: keyed replacements of the same type and format, distinct for distinct values, equal for equal ones.

Values with a format (addresses, numbers, keys) go through a keyed permutation of all values of their format, so
two of them never meet. Names draw from name lists and syllables of their script and can meet; in a script without
lists they draw from the letters of its block. A check over the distinct entities
of all documents finds surrogates that two values claim, or that are real values of the corpus; the later claimants
draw again. The few that do are broadcast if their number is within a bound, and joined to their documents beyond it.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import durable, slices, small_batches

#: Second and later draws that are still broadcast.
MAX_BROADCAST = 100_000
#: Draws after which the job fails. Formats whose values are used up grow long before.
ROUNDS = 64
#: Characters up to which a format is permuted; the keyed numbers of a permutation have as many bits as that needs.
LONG = 40
#: From this draw on a surrogate leaves its format, which may have too few values, or only the value itself.
GROW = 2

GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carl Daniel David Edgar Felix Frank George Henry Hugo Jacob Julian Leo Lucas Martin Oliver Oscar Paul Peter Robert Samuel Simon Thomas Victor Walter William".split(),
    ("latin", "f"): "Alice Amelia Anna Bella Clara Diana Elena Emma Eva Flora Grace Helen Ida Irene Julia Laura Lena Lucy Maria Martha Nina Olivia Paula Rosa Sarah Sophia Teresa Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Дмитрий Иван Кирилл Максим Олег Павел Роман Сергей Юрий".split(),
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Светлана".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    ("cjk", "m"): "伟 强 军 磊 洋 勇 杰 涛 健 翔".split(),
    ("cjk", "f"): "芳 娜 敏 静 丽 艳 娟 霞 美 花".split(),
    ("arabic", "m"): "أحمد محمود يوسف كريم سامي طارق عمر خالد حسن علي".split(),
    ("arabic", "f"): "فاطمة ليلى مريم سارة هدى نور أمينة سلمى زينب".split(),
    ("hebrew", "m"): "דוד יוסף משה אורי יונתן איתן אבנר".split(),
    ("hebrew", "f"): "שרה רחל מרים נועה תמר יעל חנה".split(),
    ("devanagari", "m"): "राम अमित विजय सुनील राजेश मोहन अशोक".split(),
    ("devanagari", "f"): "सीता गीता अनीता सुनीता रेखा पूजा".split(),
    ("thai", "m"): "สมชาย วิชัย ประเสริฐ สุรชัย อนันต์".split(),
    ("thai", "f"): "สมหญิง มาลี สุดา วรรณา พรทิพย์".split(),
}
SYLLABLES = {
    "latin": "ba be bor car del den dor fal fen gar gen hal han hol jan kel lan ler lin lor mal mar men mor nel nor par pel ran rel rin ros sal ser sol tan tar tel ton var ven vin wal wen".split(),
    "cyrillic": "ба бор ва вол гор да дер ка кол ла лев ма мир на нов па пет ра ром са сер та тор".split(),
    "greek": "βα γα δη κα κο λα λι μα μη να νι πα πε ρα ρι σα σο τα τρι".split(),
    "cjk": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗".split(),
    "arabic": "با دا را سا شا فا كا لا ما نا بو دو رو سو مي ني لي ري".split(),
    "hebrew": "בא גא דא הל לב מן נר עמ פז רן שי תל בר גל דן".split(),
    "devanagari": "का गा ता दा ना पा बा मा रा ला वा सा ही नी मी री".split(),
    "thai": "กา คา ดา ตา นา บา พา มา รา ลา วา สา นี มี รี ดี".split(),
}
ENDS = {("latin", "m"): "o", ("latin", "f"): "a", ("cyrillic", "m"): "ий", ("cyrillic", "f"): "а", ("greek", "m"): "ος", ("greek", "f"): "η"}
TITLES = {"mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "dr": "", "prof": "", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f"}

_LETTER = r"[\p{L}\p{M}\p{N}_]"
_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]*(?:['’-][\p{L}\p{M}]+)*"
_WORDS = regex.compile(_WORD)
_NAME = regex.compile(rf"(?<!{_LETTER})(?:(?P<title>(?i:{'|'.join(TITLES)}))\.?[ \t]+|(?i:my name is|i am called|name:)[ \t]+)(?P<names>{_WORD}(?:[ \t]+{_WORD}){{0,2}})")
_CUES = [*TITLES, "my name is", "i am called", "name:"]
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_DIGIT = re.compile(r"\d")
_FOREIGN = re.compile(r"[^\x00-\x7F]")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])")
_NUMBER = re.compile(r"(?<![\w.])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w]|\.[0-9])|(?<![\w.])3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5}(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9][0-9]-(?!0000)[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\w|\.[0-9])|(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-])")
_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?([^\s\"',;]{6,})")


def plain_digits(text: str) -> str:
    """The text with the decimal digits of every script as 0-9, so that numbers are found in any of them."""
    if not _FOREIGN.search(text) or not any(c > "\x7f" for c in _DIGIT.findall(text)):
        return text
    return _DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def in_script(mention: str, new: str) -> str:
    """new with its digits in the script of the mention's."""
    if mention.isascii() or len(mention) != len(new):
        return new
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(d)) if c > "\x7f" and c.isdecimal() and d in "0123456789" else d for c, d in zip(mention, new, strict=True))


def luhn(digits: str) -> int:
    """The check digit behind these digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


@lru_cache(maxsize=1)
def _cues():
    a = ahocorasick.Automaton()
    for c in _CUES:
        for form in (c, c.title(), c.capitalize(), c.upper()):
            a.add_word(form, 1)
    a.make_automaton()
    return a


def script_of(word: str) -> str:
    """The script of a word's first letter: one of SYLLABLES, or the number of its block of 128 characters."""
    name = unicodedata.name(word[:1], "LATIN").split()[0].lower()
    return name if name in SYLLABLES else f"u{ord(word[:1]) >> 7:x}"


@lru_cache(maxsize=1000)
def letters_of(script: str) -> tuple[str, ...]:
    """The syllables of a script; of one without a list the small letters, or letters without case, of its block."""
    if script in SYLLABLES:
        return tuple(SYLLABLES[script])
    start = int(script[1:], 16) << 7
    block = [chr(c) for c in range(start, start + 128)]
    own = [c for c in block if unicodedata.category(c) in ("Ll", "Lo") and c.upper().lower() == c]
    return tuple(own or SYLLABLES["latin"])


def _gender(given: str, title: str) -> str:
    if title:
        return title
    s = script_of(given)
    for g in "mf":
        if given.title() in GIVEN.get((s, g), ()):
            return g
    return "f" if given[-1:].lower() in "aeаяαηة" else "m"


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of a text, in order, without overlaps; of those that start at one place the longest wins.

    Digits of any script are read as 0-9 in values.
    """
    if not text:
        return []
    text = plain_digits(text)
    found: list[tuple[int, int, str, str]] = []
    add = lambda m, kind, g=0: found.append((*m.span(g), kind, m[g]))
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email")
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            add(m, "secret", 1)
    if _DIGIT.search(text):
        for kind, pattern in (("key", _KEY), ("ssn", _SSN)):
            for m in pattern.finditer(text):
                add(m, kind)
        for m in _IBAN.finditer(text):
            flat = m[0].replace(" ", "")
            if 15 <= len(flat) <= 34 and iban_check(flat[:2], flat[4:]) == flat[2:4]:
                add(m, "iban")
        for m in _IPV4.finditer(text):
            add(m, "ip")
        for m in _NUMBER.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits[:-1]) == int(digits[-1]):
                add(m, "card")
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                add(m, "phone")
    if any(True for _ in _cues().iter(text)):
        tokens: dict[str, str] = {}
        for m in _NAME.finditer(text):
            words = _WORDS.findall(m["names"])
            title = TITLES.get((m["title"] or "").lower(), "")
            for i, w in enumerate(words):
                family = i == len(words) - 1 and (len(words) > 1 or bool(m["title"]))
                kind = f"family/{script_of(w)}" if family else f"given/{script_of(w)}/{_gender(w, title)}"
                tokens.setdefault(w, kind)
        if tokens:
            tokens |= {w.upper(): k for w, k in tokens.items() if w.upper() not in tokens and len(w) > 1}
            for m in regex.finditer(rf"(?<!{_LETTER})\L<names>(?!{_LETTER})", text, names=list(tokens)):
                found.append((*m.span(), tokens[m[0]], m[0]))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def canonical(kind: str, value: str) -> tuple[str, str]:
    """(space, value) under which mentions are the same entity: letter case and separators don't matter."""
    top = kind.split("/")[0]
    if top == "email":
        return "email", value.lower()
    if top in ("card", "iban", "ssn"):
        return top, re.sub(r"[ -]", "", value)
    if top == "phone":
        return "phone", ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    if top in ("given", "family"):
        return top, f"{kind}:{value.lower()}"
    return top, value


class Surrogates:
    """Keyed draws. draw(space, value, attempt) is the canonical surrogate; render() puts it into a mention's format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A keyed permutation of 0..n-1: an unbalanced Feistel network over a x b >= n, walked until it is back inside."""
        if n < 2:
            return 0
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = x % a, x // a
            for r in range(8):
                if r % 2 == 0:
                    left = (left + self.number(tweak, n, r, right)) % a
                else:
                    right = (right + self.number(tweak, n, r, left)) % b
            x = right * a + left
            if x < n:
                return x

    def shaped(self, value: str, alphabets: list[str], tweak: str) -> str:
        """Permute all strings whose i-th character is of alphabets[i].

        Beyond LONG characters each is drawn from its alphabet by a keyed stream instead: there are too many such
        strings for two to meet by chance, and the check finds them if they did.
        """
        if len(value) > LONG:
            stream = hashlib.shake_256(self.key + f"{tweak}\x1f{value}".encode("utf-8", "surrogatepass")).digest(4 * len(value))
            return "".join(al[int.from_bytes(stream[4 * i : 4 * i + 4], "big") % len(al)] for i, al in enumerate(alphabets))
        n, x = 1, 0
        for c, al in zip(value, alphabets, strict=True):
            x = x * len(al) + al.index(c)
            n *= len(al)
        x = self.permute(x, n, f"{tweak}|{'|'.join(alphabets)}")
        out = []
        for al in reversed(alphabets):
            x, i = divmod(x, len(al))
            out.append(al[i])
        return "".join(reversed(out))

    @staticmethod
    def classes(value: str) -> list[str]:
        lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
        return [digit if c in digit else lower if c in lower else lower.upper() if c in lower.upper() else c for c in value]

    @classmethod
    def fixed(cls, value: str) -> bool:
        """Whether the value is the only one of its shape."""
        return all(len(al) == 1 for al in cls.classes(value))

    def token(self, tweak: str, value: str, size: int) -> str:
        """Keyed letters and digits, for values whose shape is used up."""
        out = ""
        while len(out) < size:
            k = self.number("token", tweak, value, len(out))
            for _ in range(min(20, size - len(out))):
                k, i = divmod(k, 36)
                out += "abcdefghijklmnopqrstuvwxyz0123456789"[i]
        return out

    def draw(self, space: str, value: str, attempt: int = 0) -> str:
        t = f"{space}{attempt}"
        if space == "email":
            local, _, domain = value.rpartition("@")
            name, dot, suffix = domain.rpartition(".")
            flat = local + "@" + name
            if attempt >= GROW:
                return self.token(t, value, len(local) + attempt) + "@" + self.shaped(name, self.classes(name), t) + dot + suffix
            return self.shaped(flat, self.classes(flat), t) + dot + suffix
        if space == "ip" and attempt >= 4 * GROW:  # all like addresses are used up: one of the range for documentation
            return "2001:db8" + "".join(f":{self.number(t, value) >> 16 * i & 0xFFFF:x}" for i in range(6))
        if space == "ip":
            o = [int(x) for x in value.split(".")]
            kept = 0 if attempt >= 2 * GROW else 1 if o[0] in (10, 127) or o[0] == 0 or o[0] > 223 else 2 if o[:2] == [192, 168] else 0
            bases = [223 if i == 0 else 256 for i in range(kept, 4)]
            n, x = math.prod(bases), 0
            for d, base in zip(o[kept:], bases, strict=True):
                x = x * base + ((d - 1) % 223 if base == 223 else d)
            x = self.permute(x, n, f"{t}{o[:kept]}")
            out = []
            for base in reversed(bases):
                x, d = divmod(x, base)
                out.append(d + 1 if base == 223 else d)
            return ".".join(map(str, o[:kept] + out[::-1]))
        digit = "0123456789"
        if space in ("ssn", "phone", "key", "card", "iban") and attempt >= 4 * GROW:  # used up: longer by digits
            return self.draw(space, value, attempt % GROW) + f"{self.number(t, value) % 10 ** attempt:0{attempt}d}"
        if space == "card":
            body = self.shaped(value[:-1], [value[0], *[digit] * (len(value) - 2)], t)
            return body + str((luhn(body) + int(value[-1]) - luhn(value[:-1])) % 10)  # as right or wrong as before
        if space == "ssn":
            area, group, serial = int(value[:3]) - 1, int(value[3:5]) - 1, int(value[5:]) - 1
            x = self.permute((area * 99 + group) * 9999 + serial, 899 * 99 * 9999, t)
            x, serial = divmod(x, 9999)
            area, group = divmod(x, 99)
            return f"{area + 1:03d}{group + 1:02d}{serial + 1:04d}"
        if space == "iban":
            rest = self.shaped(value[4:], self.classes(value[4:]), t)
            return value[:2] + iban_check(value[:2], rest) + rest
        if space == "phone":
            head = 1 if value.startswith("+1") and len(value) == 12 else 0
            if head or (not value.startswith("+") and len(value) == 10):
                lead, ten = value[:-10], value[-10:]
                al = [digit[2:] if i in (0, 3) and c in digit[2:] else digit for i, c in enumerate(ten)]
                return lead + self.shaped(ten, al, t)
            keep = 3 if value.startswith("+") else 1
            return value[:keep] + self.shaped(value[keep:], [digit] * (len(value) - keep), t)
        if space == "secret" and (attempt >= GROW or self.fixed(value)):
            return self.token(t, value, len(value) + max(0, attempt - GROW))
        if space == "key":
            return value[:4] + self.shaped(value[4:], [digit + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] * (len(value) - 4), t)
        if space == "secret":
            for hexadecimal in (digit + "abcdef", digit + "ABCDEF"):
                if all(c in hexadecimal for c in value):
                    return self.shaped(value, [hexadecimal] * len(value), t)
            return self.shaped(value, self.classes(value), t)
        kind, _, name = value.partition(":")
        parts = kind.split("/")
        script = parts[1]
        k = self.number(space, value, attempt)
        pool = GIVEN.get((script, parts[2])) if parts[0] == "given" else None
        if pool:
            if attempt == 0:
                at = k % len(pool)
                return pool[(at + (pool[at].lower() == name)) % len(pool)].lower()  # never the name itself
        syl = letters_of(script)
        out = ""
        for _ in range(2 + (len(syl[0]) == 1 and script != "cjk") * 2 + (attempt + 1) // 2):
            k, i = divmod(k or self.number(space, value, attempt, out), len(syl))
            out += syl[i]
        return out + (ENDS.get((script, parts[2]), "") if parts[0] == "given" else "")

    @staticmethod
    def render(mention: str, kind: str, surrogate: str) -> str:
        """The canonical surrogate in the mention's separators and letter case."""
        top = kind.split("/")[0]
        if top in ("card", "iban", "ssn", "phone"):
            fill = iter(surrogate.lstrip("+"))
            return in_script(mention, "".join(next(fill, "") if c.isalnum() else c for c in mention)) + "".join(fill)
        if top == "email":
            return in_script(mention, "".join(s.upper() if c.isupper() else s for c, s in zip(mention, surrogate, strict=True)) if len(mention) == len(surrogate) else surrogate)
        if top in ("given", "family"):
            return surrogate.upper() if mention.isupper() and len(mention) > 1 else surrogate[:1].upper() + surrogate[1:]
        return in_script(mention, surrogate)


def replace_entities(text: str | None, makes: Surrogates, again: dict[tuple[str, str], str]) -> tuple[str | None, list[str]]:
    """The text with every entity replaced, and the entities' kinds."""
    found = find_entities(text)
    if not found:
        return text, []
    out, end = [], 0
    for a, b, kind, value in found:
        key = canonical(kind, value)
        s = again.get(key) or makes.draw(*key)
        out += [text[end:a], makes.render(text[a:b], kind, s)]
        end = b
    out.append(text[end:])
    return "".join(out), [f[2].split("/")[0] for f in found]


def resolve(entities: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """Distinct (space, value) -> (space, value, surrogate, attempt): no two values of a space share a surrogate, and
    none is a real value of that space. Ties go to the smaller value; the others draw again."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes = Surrogates(key)
        for b in slices(batches):
            rows = list(zip(*[c.to_pylist() for c in b.columns], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([makes.draw(*r) for r in rows], pa.string()), b.column(2)], ["space", "value", "surrogate", "attempt"])

    # names of a space are compared without their gender and script
    real = durable(entities.select("space", F.regexp_replace("value", "^(given|family)/[^:]*:", "").alias("surrogate")).distinct())
    left, done = entities.withColumn("attempt", F.lit(0)), None
    for k in range(rounds):
        made = durable(left.mapInArrow(propose, "space string, value string, surrogate string, attempt int"))
        firsts = made.groupBy("space", "surrogate").agg(F.min("value").alias("value"))
        good = firsts.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        good = durable(good.select("space", "value", "surrogate", F.lit(k).alias("attempt")))
        done = good if done is None else durable(done.unionByName(good))
        left = durable(made.join(good.select("space", "value"), ["space", "value"], "left_anti").select("space", "value", F.lit(k + 1).alias("attempt")))
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates still meet after {rounds} rounds")


def pseudonymize(docs: DataFrame, key: bytes = b"quadweave", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All columns of docs with the text's entities replaced, and pii_count and pii_kinds ("email:1,phone:2").

    Kinds: email, ip, card (numbers of a card's first and check digit; the new ones have them too), iban, ssn, phone, key, secret, and names that a title
    or "my name is" introduces, with all their later mentions in that text. Null texts stay null, and texts without
    entities stay as they are. Digits of other scripts are read as 0-9 and written in their script again. A value that
    is the only one of its shape (********) becomes letters and digits; where a format's values are used up the
    surrogate grows. Input columns named pii_count or pii_kinds are replaced. Repeated rows give repeated
    results; an empty table gives no rows. The same key gives the same surrogates over one corpus.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pii_count", "pii_kinds")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = {canonical(k, v) for t in b.column(0) for _, _, k, v in find_entities(t.as_py())}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*sorted(own), strict=True)], ["space", "value"])

    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    entities = durable(text.mapInArrow(detect, "space string, value string").distinct())
    again = durable(resolve(entities, key).where("attempt > 0").select("space", "value", "surrogate"))
    few = again.limit(max_broadcast + 1).count() <= max_broadcast
    extra: dict[tuple[str, str], str] = {}
    work = docs
    if few:
        extra = {(r[0], r[1]): r[2] for r in again.collect()}
    else:  # each text with such values gets its own short list by a join
        keyed = lambda d: d.withColumn("_h", F.sha2(F.col(f"`{text_col}`"), 256))

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                own = {(h, *canonical(k, v)) for t, h in zip(b.column(0), b.column(1).to_pylist(), strict=True) for _, _, k, v in find_entities(t.as_py())}
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*sorted(own), strict=True)], ["_h", "space", "value"])

        named = keyed(docs).select(F.col(f"`{text_col}`").alias("text"), "_h").mapInArrow(mentions, "_h string, space string, value string").distinct()
        lists = named.join(again, ["space", "value"]).groupBy("_h").agg(F.collect_list(F.struct("space", "value", "surrogate")).alias("_again"))
        work = keyed(docs).join(lists, "_h", "left").drop("_h")
    held = docs.sparkSession.sparkContext.broadcast(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes, shared = Surrogates(key), held.value
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            lists = b.column(b.schema.get_field_index("_again")).to_pylist() if not few else None
            texts, counts, kinds = [], [], []
            for i, t in enumerate(b.column(at)):
                own = shared if few else {(x["space"], x["value"]): x["surrogate"] for x in lists[i] or []}
                new, got = replace_entities(t.as_py(), makes, own)
                texts.append(new)
                counts.append(len(got))
                kinds.append(",".join(f"{k}:{got.count(k)}" for k in sorted(set(got))))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, (c, f) in enumerate(zip(b.columns, b.schema, strict=True)) if f.name != "_again"]
            names = [f.name for f in b.schema if f.name != "_again"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*names, "pii_count", "pii_kinds"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("pii_count", LongType()).add("pii_kinds", StringType())
    return work.mapInArrow(run, schema)
