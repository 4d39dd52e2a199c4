"""PII surrogates: detected entities get keyed, type-consistent replacements, checked for collisions.

1. Entities are found in whole texts by patterns per kind (e-mail, telephone, IP
   and MAC address, IBAN, card and other long numbers, social security number,
   URL credentials, secrets after a naming word, well-known token forms) and,
   for persons, by titles, given names and salutations, after which any one or two
   capitalised words are a name (words of any kind in scripts without case);
   parts of a name found once in a text are also found where they stand alone in it.
2. Entities are reduced to distinct (kind, canonical form) pairs. The canonical
   form folds what may differ between mentions (case, separators), so all
   mentions in all documents co-refer.
3. A surrogate is drawn from a keyed hash (BLAKE2 with the key) of kind, form and
   attempt, in the shape of the form: letters for letters of the same script
   and case, digits for digits, valid addresses for addresses, a Luhn-valid
   number for a Luhn-valid one, names of the same gender and script for names.
   Surrogates are joined against each other and against all found entities; of
   those that collide the smallest form keeps its surrogate and the others draw
   again, until none is left. So distinct entities stay distinct, and no
   surrogate is another person's real value. The smallest is a partial aggregate,
   so that the many names that draw from one short list meet in no task.
4. Mentions are replaced in the case, with the separators and in the digits they
   came in. Texts are known by 128 bits of a hash; where two should have the same,
   entities without a surrogate of the table take their first draw.

Only texts with an entity are joined with the map; all others pass by without a
shuffle. Given names, titles and salutations are short fixed lists; surnames and
given names beyond the list are made of syllables, so their number doesn't run out.

Defined cases: null and empty texts pass unchanged; overlapping matches go to
the earlier, then the longer; rows that repeat are replaced alike, whatever
their doc_id, null included; extra columns pass; an empty table passes.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytespan.llm.common import discard, fresh, salt_of, salted, saved, ship

SALTS = 16
#: Draws after which a form grows longer, so that small shapes can't run out of values.
GROW = 8

# Given names by gender and script, and titles by gender.
FEMALE = {
    "latin": "Anna Maria Laura Julia Sophie Emma Clara Helena Lucia Alice Martha Irene Sarah Emily Claire Camille Elena Carmen Ingrid Katharina Charlotte Olivia Hannah Rosa".split(),
    "cyrillic": "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Екатерина Людмила".split(),
    "greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Γεωργία".split(),
}
MALE = {
    "latin": "Peter Thomas Martin Daniel Michael Andreas Stefan Lukas Pierre Louis Henri Carlos Miguel Javier Pablo George William James Robert David Simon Oliver Anton Felix".split(),
    "cyrillic": "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Владимир Павел".split(),
    "greek": "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
}
TITLES = {"f": "Mrs Ms Miss Mme Madame Mlle Frau Sra Señora Srta Doña Lady Г-жа Госпожа Κυρία السيدة גברת".split(), "m": "Mr Mister Monsieur Herr Sr Señor Don Sir Г-н Господин Κύριος السيد מר".split(), "n": "Dr Prof Mx Доктор الدكتور".split()}
# Salutations by the gender that they tell, before the name, and the Han titles that follow a name.
GREETINGS = {"f": "Chère Estimada Querida Уважаемая Дорогая Αγαπητή".split(), "m": "Lieber Estimado Querido Уважаемый Дорогой Αγαπητέ".split(), "n": "Dear Liebe Cher Hi Hello Hey Hola Bonjour Hallo".split()}
AFTER = {"先生": "m", "女士": "f", "小姐": "f"}
#: Titles that may be written with a dot.
DOTTED = frozenset("Mr Ms Mx Mrs Mme Mlle Dr Prof Sr Sra Srta".split())
SYLLABLES = {
    "latin": "ba ber cor dan del dor fal fen gar gil hal har kel kin lan lor mar mel nor pal per ran ros sal sel tan tor val ven wes".split(),
    "cyrillic": "ба вер гор дан дол ел жар зор кал лен мар нов пет род сав тар фед хар цев шил".split(),
    "greek": "βα γορ δαν ελ ζα θεο καλ λα μαρ νικ παπ ρο σα ταρ φι χρι".split(),
}
ENDINGS = {"latin": ["son", "mann", "ard", "ez", "ton", "er"], "cyrillic": ["ов", "ин", "ский"], "greek": ["ίδης", "όπουλος", "άκης"]}
GIVEN_ENDINGS = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "o", "cyrillic": "ий", "greek": "ος"}}

PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "credential": r"(?<=://)[^\s/@:]+:[^\s/@]+(?=@)",
    "secret": r"""(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?[\w+/.\-]{8,}""",
    "token": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]+|(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[A-F]*[0-9])[0-9A-F]{32,})\b",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "mac": r"\b(?:(?:[0-9A-Fa-f]{2}:){5}|(?=[A-Fa-f-]*[0-9])(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.\d)",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?![\w]|[.-]\d)",
}
WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_titles = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_given = "|".join(sorted({n for ns in (FEMALE, MALE) for names in ns.values() for n in names}, key=len, reverse=True))
_greetings = "|".join(sorted((g for gs in GREETINGS.values() for g in gs), key=len, reverse=True))
TITLED = re.compile(rf"(?<!\w)({_titles})\.? (?=[^\W\d_])((?:{WORD})(?: (?:{WORD}))?)")
GIVEN = re.compile(rf"(?<!\w)({_given}) ({WORD})(?!\w)")
#: A salutation is followed by a given name and a surname, and something that ends it.
GREETED = re.compile(rf"(?<!\w)({_greetings}) ({WORD}) ({WORD})(?=\s*[,!:;.\n]|\s*$)")
HAN = re.compile(rf"([\u4e00-\u9fff]{{2,3}}?)({'|'.join(AFTER)})")
#: A pattern is only tried on texts where this, quickly looked for, occurs.
NEEDS = {"email": re.compile("@"), "credential": re.compile("://"), "secret": re.compile("[=:]"), "token": re.compile(r"AKIA|gh[pousr]_|sk-|xox|eyJ|[0-9]"), "ipv6": re.compile(":[0-9A-Fa-f]{1,4}:"), "mac": re.compile("[0-9A-Fa-f]{2}[:-]")}
DIGIT = re.compile(r"\d")
FOUND = {k: re.compile(p) for k, p in PATTERNS.items()}
#: A text with none of these has no entity. They are kept cheap, since every text is searched for them: one class of
#: rare characters, a few plain strings, and a capitalised word or a title before a word that may be a name.
RARE, PLAIN = r"[@:=\p{Nd}]", ("AKIA", "sk-", "xox", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", *AFTER, *(t for ts in TITLES.values() for t in ts if unicodedata.category(t[0]) == "Lo"))
CAPITALS = rf"(?:\p{{Lu}}[\p{{L}}’'-]{{1,12}}|(?:{'|'.join(sorted(DOTTED))})\.) [\p{{IsUppercase}}\p{{Lo}}]"


def hint(text: Column) -> Column:
    """Whether a text may have an entity; false for null."""
    found = text.rlike(RARE)
    for p in PLAIN:
        found = found | text.contains(p)
    return F.coalesce(found | text.rlike(CAPITALS), F.lit(False))


GENDER = {n: g for g, ns in (("f", FEMALE), ("m", MALE)) for names in ns.values() for n in names}


def script_of(text: str) -> str:
    """The script of a text's first letter: latin, cyrillic or greek, of which there are names, or other."""
    c = next((c for c in text if c.isalpha()), "a")
    if "Ѐ" <= c <= "ӿ":
        return "cyrillic"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "greek"
    return "latin" if c < "ʰ" or "Ḁ" <= c <= "ỿ" else "other"


@functools.cache
def letters_like(c: str) -> str:
    """Letters of a letter's script and case: of its alphabet, or else of the same kind in its 128 code points (Han: 2048)."""
    lower = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script_of(c))
    if lower:
        return lower.upper() if c.isupper() else lower
    wide = 2048 if "\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" else 128
    begin = ord(c) // wide * wide
    return "".join(x for x in map(chr, range(begin, begin + wide)) if unicodedata.category(x) == unicodedata.category(c)) or c


def ascii_digits(text: str) -> str:
    """Digits alone, of any script, as those of ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def canonical(kind: str, value: str) -> str:
    """One form for all mentions of an entity."""
    if kind in ("phone", "card", "ssn"):
        return ascii_digits(value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "mac":
        return value.replace("-", ":").lower()
    if kind in ("email", "ipv6") or (kind in ("token", "secret") and re.fullmatch(r"[0-9a-fA-F]+", value)):
        return value.lower()
    return value


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all entities, in order, without overlaps."""
    out = []
    for rank, (kind_, pattern) in enumerate(FOUND.items()):
        if not NEEDS.get(kind_, DIGIT).search(text):
            continue
        for m in pattern.finditer(text):
            kind, start, end, value = kind_, m.start(), m.end(), m.group()
            if kind == "secret":  # the value alone, without the word, sign and quote before it
                lead = re.match(r"""[^=:]*[=:]\s*["']?""", value).end()
                value, start = value[lead:], start + lead
                kind = "token" if re.fullmatch(r"[0-9a-fA-F]{32,}", value) else kind
            elif kind == "email":
                value = value.rstrip(".-")
                end = start + len(value)
            if value:
                out.append((start, end, kind, value, rank))
    out += [(*x, len(FOUND)) for x in people(text)]
    out.sort(key=lambda x: (x[0], -x[1], x[4]))
    kept, upto = [], 0
    for x in out:
        if x[0] >= upto:
            kept.append(x[:4])
            upto = x[1]
    return kept


def people(text: str) -> list[tuple[int, int, str, str]]:
    """Parts of persons' names: kind given_f, given_m, given_n or surname."""
    parts: dict[str, str] = {}
    out = []
    for m in TITLED.finditer(text):
        if text[m.end(1)] == "." and m[1] not in DOTTED:
            continue
        gender = next(g for g, ts in TITLES.items() if m[1] in ts)
        names = [(w.start() + m.start(2), w.end() + m.start(2), w.group()) for w in re.finditer(WORD, m[2])]
        # a script without case has no other sign of a name; there only the first word counts
        names = [n for i, n in enumerate(names) if n[2][0].isupper() and (i == 0 or names[0][2][0].isupper()) or i == 0 and unicodedata.category(n[2][0]) == "Lo"]
        if not names or (m[1] in ("Don", "Sir", "Lady", "Doña", "Sr", "Miss") and len(names[0][2]) < 3):
            continue
        if len(names) == 2:
            parts.setdefault(names[0][2], f"given_{GENDER.get(names[0][2], gender)}")
            parts.setdefault(names[1][2], "surname")
        else:
            parts.setdefault(names[0][2], "surname")
    for m in GIVEN.finditer(text):
        if m[2][0].isupper() and m[2][1:].islower():
            parts.setdefault(m[1], f"given_{GENDER[m[1]]}")
            parts.setdefault(m[2], "surname")
    for m in GREETED.finditer(text):
        if all(w[0].isupper() and w[1:].islower() for w in (m[2], m[3])):
            gender = next(g for g, words in GREETINGS.items() if m[1] in words)
            parts.setdefault(m[2], f"given_{GENDER.get(m[2], gender)}")
            parts.setdefault(m[3], "surname")
    for m in HAN.finditer(text):
        parts.setdefault(m[1][0], "surname")
        out.append((m.start(1), m.start(1) + 1, "surname", m[1][0]))
        out.append((m.start(1) + 1, m.end(1), f"given_{AFTER[m[2]]}", m[1][1:]))
        parts.pop(m[1][0])
    if parts:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", text):
            out.append((m.start(), m.end(), parts[m.group()], m.group()))
    return out


class Draw:
    """A stream of numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.pool = key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.what + b"\0" + str(self.block).encode(), key=self.key[:64], digest_size=64).digest()
            self.block += 1
        raw, self.pool = self.pool[:8], self.pool[8:]
        return int.from_bytes(raw, "big") % n

    def pick(self, options):
        return options[self.below(len(options))]


def shaped(draw: Draw, text: str, hexadecimal: bool = False) -> str:
    """Letters for letters of the same case and script, digits for digits, all else as it is."""
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append(draw.pick("0123456789abcdef"))
        elif hexadecimal and c in "ABCDEF":
            out.append(draw.pick("0123456789ABCDEF"))
        elif c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + draw.below(10)))
        elif c.isalpha():
            out.append(draw.pick(letters_like(c)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form that stands for another, in the same shape."""
    draw = Draw(key, kind, form, attempt)
    extra = attempt // GROW
    if kind == "email":
        user, _, domain = form.partition("@")
        labels = domain.split(".")
        return shaped(draw, user) + shaped(draw, "a" * extra) + "@" + ".".join([shaped(draw, x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        a = [int(x) for x in form.split(".")]
        private = 1 if a[0] in (10, 127) else 2 if (a[0] == 192 and a[1] == 168) or (a[0] == 172 and 16 <= a[1] < 32) else 0
        return ".".join(map(str, a[:private] + [1 + draw.below(254 if i or private else 223) for i in range(4 - private)]))
    if kind in ("ipv6", "mac") or (kind == "token" and re.fullmatch(r"[0-9a-fA-F]+", form)):
        return shaped(draw, form, True)
    if kind == "card":
        body = form[0] + shaped(draw, form[1:])
        if luhn(form) != luhn(body):
            body = next(b for b in (body[:-1] + str((int(body[-1]) + d) % 10) for d in range(10)) if luhn(b) == luhn(form))
        return body
    if kind == "phone":
        keep = min(max(len(form) - 10, 0), 3)
        return form[:keep] + shaped(draw, form[keep:])
    if kind == "ssn":
        return str(900 + draw.below(100)) + shaped(draw, form[3:])
    if kind == "iban":
        return form[:2] + shaped(draw, form[2:])
    if (kind.startswith("given_") or kind == "surname") and script_of(form) == "other":
        return shaped(draw, form) + shaped(draw, form[:1] * extra)
    if kind.startswith("given_"):
        script, gender = script_of(form), kind[-1]
        names = {"f": FEMALE[script], "m": MALE[script]}.get(gender, FEMALE[script] + MALE[script])
        if attempt < 2:  # the list is short: a second draw is a double name, later ones are made of syllables
            return "-".join([draw.pick(names) for _ in range(1 + attempt)])
        gender = gender if gender in GIVEN_ENDINGS else draw.pick("fm")
        return "".join(draw.pick(SYLLABLES[script]) for _ in range(2 + attempt // 2)).capitalize() + GIVEN_ENDINGS[gender][script]
    if kind == "surname":
        script = script_of(form)
        return "".join(draw.pick(SYLLABLES[script]) for _ in range(2 + draw.below(2) + extra)).capitalize() + draw.pick(ENDINGS[script])
    return shaped(draw, form) + shaped(draw, "a" * extra)


def rendered(kind: str, mention: str, new: str) -> str:
    """A surrogate in the case and with the separators of a mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest, zero = iter(new), next((ord(c) - unicodedata.decimal(c) for c in mention if c.isdecimal()), 48)
        if zero != 48:
            rest = iter([chr(zero + int(c)) if c.isdecimal() else c for c in new])
        return "".join(next(rest, "") if c.isalnum() else c for c in mention) + "".join(rest)
    if kind == "mac" and "-" in mention:
        new = new.replace(":", "-")
    if mention.isupper() and any(c.isalpha() for c in mention):
        return new.upper()
    return new


def occurrences(texts: DataFrame) -> DataFrame:
    """Distinct (mark, kind, form) of (mark, text): equal texts have equal marks and entities."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {(m, k, canonical(k, v)) for m, t in zip(frame["mark"].tolist(), frame["text"].tolist(), strict=True) for _, _, k, v in mentions(t)}
            yield pd.DataFrame(sorted(out), columns=["mark", "kind", "form"])

    return texts.mapInPandas(run, "mark string, kind string, form string").distinct()


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, surrogate), all surrogates distinct within a kind and none of them a form that occurs.

    Each round draws for those that are still without; only a count of them comes to the driver."""
    ship(entities.sparkSession)
    group = F.when(F.col("kind").startswith("given_"), F.lit("given")).otherwise(F.col("kind"))

    def draw(attempt: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(surrogate=[surrogate(key, k, f, attempt) for k, f in zip(frame["kind"], frame["form"], strict=True)])
        return run

    open_ = entities.select("kind", "form", group.alias("pool"))
    real = open_.select("pool", F.col("form").alias("surrogate"))
    done, attempt = None, 0
    while True:
        tried = saved(open_.mapInPandas(draw(attempt), "kind string, form string, pool string, surrogate string"))
        first = tried.groupBy("pool", "surrogate").agg(F.min(F.struct("form", "kind")).alias("first"))
        used = real if done is None else real.union(done.select("pool", "surrogate"))
        good = first.join(used, ["pool", "surrogate"], "left_anti").select("first.kind", "first.form", "pool", "surrogate")
        before, done = done, saved(good if done is None else done.union(good))
        open_ = tried.join(done.select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form", "pool")
        if before is not None:
            discard(before, held)
        held, attempt = tried, attempt + 1
        if not open_.limit(1).count():
            return done.select("kind", "form", "surrogate")


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with every detected entity of the text column replaced; other columns and rows as they are."""
    ship(docs.sparkSession)
    mark, found, salt = fresh(docs, "_mark", "_found", "_salt")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hit = hint(F.col(f"`{text}`"))
    some = saved(docs.filter(hit).withColumn(mark, F.md5(F.col(f"`{text}`"))))
    own = saved(occurrences(some.select(F.col(mark).alias("mark"), F.col(f"`{text}`").alias("text"))))
    table = saved(assigned(saved(own.select("kind", "form").distinct()), key))
    own = own.withColumn(salt, salt_of(SALTS, "mark")).join(salted(table, SALTS, salt), ["kind", "form", salt])
    maps = own.groupBy("mark").agg(F.collect_list(F.concat_ws("\0", "kind", "form")).alias(found), F.collect_list("surrogate").alias(salt))
    joined = some.join(maps.withColumnRenamed("mark", mark), mark, "left")

    @F.pandas_udf("string")
    def put(texts: pd.Series, forms: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for t, f, n in zip(texts, forms, news, strict=True):
            if f is None or not len(f):
                out.append(t)
                continue
            new, parts, at = dict(zip(f, n, strict=True)), [], 0
            for start, end, kind, value in mentions(t):
                form = canonical(kind, value)
                parts += [t[at:start], rendered(kind, value, new.get(f"{kind}\0{form}") or surrogate(key, kind, form, 0))]
                at = end
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    new = [put(F.col(f"`{c}`"), F.col(found), F.col(salt)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*new).union(docs.filter(~hit).select(*cols))
