"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by patterns; each is replaced by a keyed surrogate of its kind: the same entity gets the same one in
every document (coreference), other entities get other ones (distinctness, checked over the whole corpus), and gender,
script, length, case, separators, check digits and fixed prefixes are kept. Names are replaced word by word, so a
surname stands for the same person with or without the given name. A given name has the gender that its titles agree
on over the whole corpus (neither, if they don't), so a neutral title or none leads to the same surrogate. A name of two
words or more that a text has with a title is replaced in that text where it has none as well.

A surrogate is a pure expression of the entity and a number of attempts. The check collects distinct entities in a
table, and only those whose surrogate is taken, or is itself an entity of the corpus, try again; numbers of a form whose
space is full are permuted within it; documents with such an
entity, or with a given name of several titles, get what the table says by a join, all others need none.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, parts

#: Titles that introduce a name, with the gender that they tell.
MALE, FEMALE, EITHER = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Госпожа", "Κυρία"), ("Dr", "Prof")
ARABIC_MALE, ARABIC_FEMALE = ("السيد", "الدكتور", "الأستاذ"), ("السيدة", "الدكتورة", "الأستاذة")
HAN_MALE, HAN_FEMALE = "先生", ("女士", "小姐")
#: Words between the capitalised ones of a name.
PARTICLES = ("de la", "de los", "del", "de", "van der", "van den", "van", "von", "da", "di", "dos", "du", "la", "le", "bin", "al", "y")
NAME_WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)*+"
ARABIC_WORD = r"[\p{IsArabic}&&\p{L}]{2,}+"
#: Kinds in the order in which they are looked for; a match of an earlier one is not looked at again.
PATTERNS = {
    "secret": r"(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
    "access_key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "credential": r"(?<![A-Za-z0-9_-])(?:Bearer [A-Za-z0-9._~+/-]{16,}={0,2}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[opsru]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:.])|(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\p{L}\p{N}:.])|(?:(?<![\p{L}\p{N}:.\[(])|(?<=//\[))(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]{0,40}[0-9])(?:[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\p{L}\p{N}:.])",
    "han_name": rf"[\p{{IsHan}}]{{2,4}}(?:{'|'.join((HAN_MALE, *HAN_FEMALE))})",
    "arabic_name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((*ARABIC_FEMALE, *ARABIC_MALE))}) {ARABIC_WORD}(?: {ARABIC_WORD})?",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((*MALE, *FEMALE, *EITHER))})\.? {NAME_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) )?{NAME_WORD})*+",
}
#: Kinds that may begin beside a letter or digit: a secret's keyword ends longer names (accessToken, dbPassword), keys and
#: account numbers mind ASCII only, and no space precedes names in Han characters.
ANYWHERE = ("secret", "access_key", "iban", "han_name")
#: The others begin where no letter or digit stands before: one test for them spares their patterns at other places.
ANY = "|".join(PATTERNS[k] for k in ANYWHERE[:-1]) + r"|(?<![\p{L}\p{N}])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in ANYWHERE) + ")|" + PATTERNS["han_name"]
#: Whole entities, to tell their kind again.
WHOLE = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
HEX, DIGITS = "0123456789abcdef", "0123456789"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Consonants, vowels, and endings that sound male, female and neither, for each script.
SCRIPTS = {
    "greek": ("βγδκλμνπρστφ", "αειου", ("ος", "ης", "ων"), ("α", "ια", "ινα"), ("ι", "ε", "υ")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("ан", "ир", "ей"), ("а", "ия", "ина"), ("и", "е", "у")),
    "arabic": ("بتجدرزسعفقكلمنه", "اوي", ("ان", "ير", "اد"), ("ة", "اء", "ى"), ("ي", "و", "ين")),
    "latin": ("bdfghklmnprstvw", "aeiou", ("an", "us", "er"), ("a", "ia", "ine"), ("e", "y", "is")),
}
#: Common characters of Chinese names: surnames, then given names of men, of women and of both.
HAN = ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧", "伟强磊军勇杰涛超刚平辉鹏鑫波斌浩健峰龙建", "芳娜敏静丽艳娟霞秀玲桂英红玉兰梅琳雪莹洁", "华明文晓志云永春金林宁清新国安宇晨乐佳子")
MOST_ATTEMPTS = 50
#: Kinds whose surrogates can't grow, as their length is fixed. Where some of one form still collide after so many attempts
#: (its space may be full), all of that form are settled by a keyed permutation of its space, so that none can collide.
FIXED_KINDS = ("ssn", "card", "ipv4", "ipv6", "iban", "access_key", "phone0", "phone1", "phone2", "phone3")
SETTLED_AFTER, PERMUTED = 4, -1
#: What stays of a credential, and of the others of its kind.
CREDENTIAL_HEAD = "^(?:Bearer |(?:sk|pk|rk)[-_](?:live_|test_|proj-)?|gh[opsru]_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ)"
#: Attempts after which a surrogate may be a character longer, so that no space of surrogates is ever used up.
GROWS_AFTER = 8
#: Characters that a mailbox's surrogate has at least.
SHORT_MAILBOX = 8
#: Units that the table may tell of in one map; more are joined to the documents that hold them.
TOLD_UNITS = 2_000
#: Rows of the table of entities that a task is meant to hold.
TASK_UNITS = 2_000
#: The session's setting that names the key.
KEY_SETTING = "spark.strandloom.surrogates.key"


@cache
def drawn_key() -> str:
    """A key of this process, for runs that name none: nobody who reads the code can test guesses against it."""
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or drawn_key()


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits that depend on all of these."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _byte(stream: Column, i: Column | int) -> Column:
    at = F.lit(2 * i + 1) if isinstance(i, int) else (i * 2) % 126 + 1
    return F.conv(stream.substr(at, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is written and evaluated once, however often ``use`` has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pick(letters: Column, number: Column) -> Column:
    return letters.substr(number % F.length(letters) + 1, F.lit(1))


def _among(ch: Column, first: str, last: str) -> Column:
    return (ch >= first) & (ch <= last)


def _letters(ch: Column, small: Column) -> Column:
    """The class of a character, as all its members; a character of no class is the only one of its own."""
    return F.when(_among(ch, "0", "9"), F.lit(DIGITS)).when(_among(ch, "a", "z"), small).when(_among(ch, "A", "Z"), F.lit(UPPER)).otherwise(ch)


def _characters(value: Column) -> Column:
    """A string's characters as an array: reading each by its place would take time in the square of the length."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def _shaped(value: Column, stream: Column, keep: Column, small: Column) -> Column:
    """Digits, small and capital letters replaced by others of their class; the first ``keep`` characters stay."""
    one = lambda ch, i: _pick(F.when(i < keep, ch).otherwise(_letters(ch, small)), _byte(stream, i + 1))
    return F.when(F.length(value) > 0, F.array_join(F.transform(_characters(value), one), "")).otherwise(value)


def _permuted(value: Column, keep: Column, key: str, kind: Column, small: Column) -> Column:
    """A keyed permutation of the strings of a form: no two have the same result.

    Each character moves on within its class by a hash of the results before it, then, from the end, by a hash of the
    results behind it; either step can be undone, and together every character depends on all others.
    """

    def turn(word: Column, salt: str, from_end: bool) -> Column:
        def step(done: Column, i: Column) -> Column:
            at = F.length(word) - i + 1 if from_end else i
            ch = word.substr(at, F.lit(1))
            among = F.when(at <= keep, ch).otherwise(_letters(ch, small))
            move = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(salt), kind, at.cast("string"), done), 256), 1, 12), 16, 10).cast("long")
            new = _let(among, lambda l: l.substr(((F.instr(l, ch) - 1 + move) % F.length(l) + 1).cast("int"), F.lit(1)))
            return F.concat(new, done) if from_end else F.concat(done, new)

        return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.lit(""), step)

    return _let(turn(value, "there", False), lambda w: turn(w, "back", True))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, the last one being the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        twice = digits.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _word(word: Column, stream: Column, gender: Column, extra: Column) -> Column:
    """A name of the word's script: syllables (``extra`` more than usual) and an ending of the gender."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsArabic}"), "arabic").otherwise("latin")
    of = lambda script, get: reduce(lambda c, k: c.when(script == k, get(SCRIPTS[k])), list(SCRIPTS)[1:], F.when(script == "greek", get(SCRIPTS["greek"])))

    def made(script: Column) -> Column:
        consonants, vowels = of(script, lambda x: F.lit(x[0])), of(script, lambda x: F.lit(x[1]))
        ends = of(script, lambda x: F.when(gender == "m", F.array(*map(F.lit, x[2]))).when(gender == "f", F.array(*map(F.lit, x[3]))).otherwise(F.array(*map(F.lit, x[4]))))
        syllables = _let(F.struct(consonants.alias("c"), vowels.alias("v")), lambda l: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), extra + 3), lambda i: F.concat(_pick(l["c"], _byte(stream, i)), _pick(l["v"], _byte(stream, i + 8)))), ""), _pick(l["c"], _byte(stream, 20))))
        return F.initcap(F.concat(syllables, F.element_at(ends, _byte(stream, 21) % 3 + 1)))

    return _let(script, made)


def _han(name: Column, stream: Column, gender: Column, extra: Column) -> Column:
    """A surname and, for the rest of the length, characters of given names of the gender."""
    given = F.when(gender == "m", HAN[1]).when(gender == "f", HAN[2]).otherwise(HAN[3])
    rest = F.transform(F.sequence(F.lit(1), F.length(name) + extra), lambda i: F.when(i < F.length(name) + extra, _pick(given, _byte(stream, i))).otherwise(""))
    return F.concat(_pick(F.lit(HAN[0]), _byte(stream, 0)), F.array_join(rest, ""))


def kind_of(entity: Column) -> Column:
    """The kind whose pattern an entity is; ``mention`` for a name without its title."""
    return reduce(lambda c, k: c.when(entity.rlike(WHOLE[k]), F.lit(k)), list(PATTERNS)[1:], F.when(entity.rlike(WHOLE["secret"]), F.lit("secret"))).otherwise(F.lit("mention"))


def name_words(entity: Column, kind: Column) -> Column:
    """The words of a name without its title."""
    words = F.split(entity, " ")
    return F.when(kind == "mention", words).otherwise(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))


def units(entity: Column, kind: Column) -> Column:
    """What an entity is replaced by parts of: ``array<struct<kind, canon, hint>>``, the units of distinctness.

    A name's words are units of their own, given names and the surname, the last word; so are an address and its domain.
    ``hint`` is the gender that the title tells, ``n`` if none.
    """
    unit = lambda k, c, h=F.lit(""): F.struct(k.alias("kind"), c.alias("canon"), h.alias("hint"))
    words = name_words(entity, kind)
    title = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", "")
    hint = F.when(kind == "mention", "n").when(title.isin(*MALE, *ARABIC_MALE), "m").when(title.isin(*FEMALE, *ARABIC_FEMALE), "f").otherwise("n")
    name_units = F.transform(words, lambda w, i: unit(F.when(i < F.size(words) - 1, F.lit("given")).otherwise(F.lit("surname")), F.initcap(w), F.when(i < F.size(words) - 1, hint).otherwise("")))
    canon = (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(entity, r"[ ()+.-]", ""))
        .when(kind == "secret", F.regexp_extract(entity, r"[=:]\s*[\"']?(.*?)[\"']?$", 1))
        .when(kind == "han_name", F.regexp_extract(entity, f"^(.*)({'|'.join((HAN_MALE, *HAN_FEMALE))})$", 1))
        .otherwise(entity)
    )
    # a phone number's country code is part of its kind, as that many digits stay
    code = F.length(F.regexp_extract(entity, r"^\+([0-9]{1,3})[^0-9]", 1)).cast("string")
    han_hint = F.when(kind == "han_name", F.when(entity.endswith(HAN_MALE), "m").otherwise("f")).otherwise("")
    alone = F.array(unit(F.when(kind == "phone", F.concat(kind, code)).otherwise(kind), canon, han_hint))
    address = F.array(unit(F.lit("mailbox"), canon), unit(F.lit("domain"), F.substring_index(canon, "@", -1)))
    return F.when(kind.isin("name", "arabic_name", "mention"), name_units).when(kind == "email", address).otherwise(alone)


def _keep(kind: Column, canon: Column) -> Column:
    """How many characters of a unit stay as they are."""
    head = F.length(F.regexp_extract(canon, CREDENTIAL_HEAD, 0))
    return F.when(kind == "access_key", 4).when(kind == "iban", 2).when(kind == "card", 1).when(kind.startswith("phone"), kind.substr(6, 1).cast("int")).when(kind == "credential", head).otherwise(0)


def _form(kind: Column, canon: Column) -> Column:
    """What a unit of a fixed kind shares with all that its surrogate may be."""
    rest = canon.substr(_keep(kind, canon) + 1, F.length(canon))
    shape = F.translate(rest, DIGITS + LOWER + UPPER, "0" * 10 + "a" * 26 + "A" * 26)
    return F.when(kind == "ipv4", "").otherwise(F.concat(canon.substr(F.lit(1), _keep(kind, canon)), shape))


def _settled(kind: Column, canon: Column, key: str) -> Column:
    """The surrogate of a unit of a fixed kind by a permutation of its form's space."""
    small = F.when(kind == "ipv6", "abcdef").otherwise(LOWER)
    octets = F.transform(F.split(canon, r"\."), lambda o: F.format_string("%02x", o.cast("int")))
    address = _let(F.array_join(octets, ""), lambda x: _permuted(F.translate(x, HEX, LOWER[:16]), F.lit(0), key, kind, F.lit(LOWER[:16])))
    dotted = _let(address, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.translate(x.substr(i, F.lit(2)), LOWER[:16], HEX), 16, 10)), "."))
    # a card's check digit stays as far from the right one as it was
    body = canon.substr(F.lit(1), F.length(canon) - 1)
    off = _luhn(canon)
    card = _let(_permuted(body, F.lit(1), key, kind, small), lambda b: F.concat(b, ((20 - _luhn(F.concat(b, F.lit("0"))) + off) % 10).cast("string")))
    return F.when(kind == "ipv4", dotted).when(kind == "card", card).otherwise(_permuted(canon, _keep(kind, canon), key, kind, small))


def unit_surrogate(kind: Column, canon: Column, gender: Column, attempt: Column, h: Column, key: str) -> Column:
    """The surrogate of a unit in canonical form from its stream ``h``, a pure expression of its arguments.

    Of an address it is the new mailbox before the old domain.
    """
    extra = F.floor(F.greatest(attempt, F.lit(0)) / GROWS_AFTER).cast("int")
    local, top = F.substring_index(canon, "@", 1), F.substring_index(canon, ".", -1)
    body = F.when(kind == "mailbox", local).when(kind == "domain", canon.substr(F.lit(1), F.length(canon) - F.length(top))).otherwise(canon)
    # mailboxes of a few characters would soon have no other of their length left
    spare = extra + F.when(kind == "mailbox", F.greatest(F.lit(0), F.lit(SHORT_MAILBOX) - F.length(body))).otherwise(0)
    longer = F.when(kind == "domain", F.concat(F.repeat(F.lit("a"), extra), body)).when(kind.isin("mailbox", "secret", "credential"), F.concat(body, F.repeat(F.lit("a"), spare))).otherwise(body)
    keep = _keep(kind, canon)
    hexadecimal = (kind == "ipv6") | ((kind == "secret") & canon.rlike("^[0-9a-f]+$"))
    # what does not differ between characters is evaluated once, not for each of them
    shaped = _let(F.struct(longer.alias("v"), keep.alias("keep"), F.when(hexadecimal, "abcdef").otherwise(LOWER).alias("small")), lambda x: _shaped(x["v"], h, x["keep"], x["small"]))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(h, i) % 254 + 1).cast("string")), ".")

    def finished(shaped: Column) -> Column:
        front = shaped.substr(F.lit(1), F.length(shaped) - 1)
        check = lambda f: F.concat(f, ((10 - _luhn(F.concat(f, F.lit("0")))) % 10).cast("string"))
        return (
            F.when(kind == "mailbox", F.concat(shaped, F.lit("@"), F.substring_index(canon, "@", -1)))
            .when(kind == "domain", F.concat(shaped, top))
            .when(kind == "card", F.when(_luhn(canon) == 0, _let(front, check)).otherwise(shaped))
            .otherwise(shaped)
        )

    return (
        F.when(attempt == PERMUTED, _settled(kind, canon, key))
        .when(kind == "ipv4", octets)
        .when(kind == "han_name", _han(canon, h, gender, extra))
        .when(kind.isin("given", "surname"), _word(canon, h, gender, extra))
        .otherwise(_let(shaped, finished))
    )


def _cased(form: Column, s: Column) -> Column:
    """``s`` in the case of ``form``, letter by letter as far as both go."""
    one = lambda form, s, i: F.when(form.substr(i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(s.substr(i, F.lit(1)))).otherwise(s.substr(i, F.lit(1)))
    cased = lambda form, s: F.when((form != F.lower(form)) & (F.length(s) > 0), F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: one(form, s, i)), "")).otherwise(s)
    return _let(F.struct(form.alias("form"), s.alias("s")), lambda x: cased(x["form"], x["s"]))


def _like_word(word: Column, s: Column) -> Column:
    """A name's word in the case of the word that it stands for."""
    return F.when((word == F.upper(word)) & (word != F.lower(word)), F.upper(s)).when((word == F.lower(word)) & (word != F.upper(word)), F.lower(s)).otherwise(s)


def _poured(form: Column, letters: Column) -> Column:
    """``letters`` in the places of ``form``'s letters and digits; separators stay. Both have as many."""

    def step(acc: Column, i: Column) -> Column:
        ch = form.substr(i, F.lit(1))
        takes = ch.rlike("[A-Za-z0-9]")
        out = F.concat(acc["out"], F.when(takes, letters.substr(acc["at"], F.lit(1))).otherwise(ch))
        return F.struct(out.alias("out"), (acc["at"] + F.when(takes, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.sequence(F.lit(1), F.length(form)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])


def _whole(entity: Column, kind: Column, parts: Column) -> Column:
    """The surrogate of an entity in the form of the entity, from those of its units."""
    one = F.element_at(parts, 1)
    words = F.zip_with(name_words(entity, kind), parts, _like_word)
    name = F.array_join(F.when(kind == "mention", words).otherwise(F.concat(F.array(F.substring_index(entity, " ", 1)), words)), " ")
    return (
        F.when(kind.isin("name", "arabic_name", "mention"), name)
        .when(kind == "email", F.concat(_cased(F.substring_index(entity, "@", 1), F.substring_index(one, "@", 1)), F.lit("@"), _cased(F.substring_index(entity, "@", -1), F.get(parts, F.lit(1)))))
        .when(kind == "ipv6", _cased(entity, one))
        .when(kind.isin("card", "phone", "ssn", "iban"), _poured(entity, one))
        .when(kind == "secret", F.concat(F.regexp_extract(entity, r"^(.*?[=:]\s*[\"']?)", 1), one, F.regexp_extract(entity, r"([\"']?)$", 1)))
        .when(kind == "han_name", F.concat(one, F.regexp_extract(entity, f"({'|'.join((HAN_MALE, *HAN_FEMALE))})$", 1)))
        .otherwise(one)
    )


def with_entities(docs: DataFrame, text: Column, entities: str, pattern: str, known: str) -> DataFrame:
    """``docs`` with the entities of each text, and the pattern that finds them where it is not ANY alone.

    The pattern of a text that has titled names of two words or more also finds these names without a title.
    """
    docs = docs.withColumn(known, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    titled = rf"^(?:{'|'.join((*MALE, *FEMALE, *EITHER))})\.? {NAME_WORD} |^(?:{'|'.join((*ARABIC_FEMALE, *ARABIC_MALE))}) {ARABIC_WORD} "
    names = F.transform(F.filter(known, lambda e: e.rlike(titled)), lambda e: F.regexp_replace(e, "^[^ ]+ ", ""))
    longest = F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(longest, lambda x: x["n"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    docs = docs.withColumn(pattern, F.when(F.exists(known, lambda e: e.rlike(titled)), again))
    return docs.withColumn(entities, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(text, F.col(pattern), F.lit(0))).otherwise(F.col(known)))


def settled_units(docs: DataFrame, text: str, key: str) -> DataFrame | None:
    """``kind, canon, attempt, gender`` of the units whose surrogate their text alone does not tell; None if there are none.

    These are units whose first surrogate would collide, and given names whose titles do not all tell the same. A
    surrogate collides if another unit of its kind has it or a unit of the corpus is it. Of units that want the same
    one, the first in code-point order has it; the others try again. Units of a fixed form that may have no free
    surrogate left are settled by a permutation: then they are distinct, but may be other units of the corpus.
    """
    found = with_entities(docs.select(F.col(f"`{text}`").alias("text")), F.col("text"), "e", "pattern", "known")
    # outer, as a filter on the entities would be moved below them and evaluate every pattern again
    found = found.select(F.explode_outer("e").alias("e")).groupBy("e").agg(F.lit(1).alias("x")).where("e is not null")
    unit = found.select(F.explode(units(F.col("e"), kind_of(F.col("e")))).alias("u")).select("u.*")
    told = [F.max(F.when(F.col("hint") == g, True)).isNotNull() for g in ("m", "f", "n")]
    unit = unit.groupBy("kind", "canon").agg(*[t.alias(g) for t, g in zip(told, ("m", "f", "n"), strict=True)])
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    mixed = sum((F.col(g).cast("int") for g in ("f", "n")), F.col("m").cast("int")) > 1
    table = checkpointed(unit.select("kind", "canon", F.lit(0).alias("attempt"), gender.alias("gender"), mixed.alias("mixed"), F.lit(None).cast("string").alias("s")))
    real = table.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
    tasks = parts(table.count(), TASK_UNITS)
    for turns in range(MOST_ATTEMPTS):
        made = table.repartition(tasks, "kind", "canon").withColumn("h", F.when(F.col("s").isNull(), _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
        made = made.withColumn("s", F.when(F.col("s").isNull(), unit_surrogate(F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"), F.col("h"), key)).otherwise(F.col("s"))).drop("h")
        turn = F.row_number().over(Window.partitionBy("kind", "s").orderBy("attempt", "canon"))
        seen = made.withColumn("turn", turn).join(real, ["kind", "s"], "left")
        again = ((F.col("turn") > 1) | F.coalesce("real", F.lit(False))) & (F.col("attempt") != PERMUTED)
        seen = checkpointed(seen.select("kind", "canon", "attempt", "gender", "mixed", "s", again.alias("again")))
        if not seen.where("again").limit(1).count():
            changed = seen.where("attempt <> 0 or mixed").select("kind", "canon", "attempt", "gender")
            return changed if changed.limit(1).count() else None
        if turns >= SETTLED_AFTER:  # all of a form at once, as only then they can't meet
            form = _form(F.col("kind"), F.col("canon"))
            full = seen.where(F.col("again") & F.col("kind").isin(*FIXED_KINDS)).select(F.col("kind").alias("full"), form.alias("form")).distinct()
            seen = seen.join(full, (F.col("kind") == F.col("full")) & (form == F.col("form")), "left").withColumn("settles", F.col("full").isNotNull())
            seen = seen.withColumns({"attempt": F.when(F.col("settles"), PERMUTED).otherwise(F.col("attempt")), "s": F.when(~F.col("settles"), F.col("s")), "again": F.col("again") & ~F.col("settles")})
        table = seen.select("kind", "canon", F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), "gender", "mixed", F.when(~F.col("again"), F.col("s")).alias("s"))
    raise ValueError(f"{MOST_ATTEMPTS} attempts did not make all surrogates distinct: a kind's space is too small")


def with_surrogates(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with its texts' entities replaced, and ``n_replaced``, the number of entities.

    ``key`` decides the surrogates; keep it secret. Without one, a key of this process is drawn, so that runs of one
    process agree. All rows and columns are kept; a column of its own called n_replaced is replaced. Null texts stay
    null (0 replaced), empty ones empty. Rows may repeat, and no column but the text is read; an empty table gives an empty result. What
    surrogates an entity has depends on the key, and, where two collide or titles differ, on the corpus.
    """
    key = key or drawn_key()
    docs = docs.drop("n_replaced")
    changed = settled_units(docs, text, key)
    mark = uuid.uuid4().hex
    e, pattern, known, k, u, s, r, pieces, ids, told = (f"{x} {mark}" for x in ("entities", "pattern", "known", "kinds", "units", "surrogates", "replacements", "pieces", "id", "told"))
    t = F.col(f"`{text}`")
    name = lambda u: F.concat(u["kind"], F.lit("\x1f"), u["canon"])
    entry = F.struct(F.concat("kind", F.lit("\x1f"), "canon").alias("k"), F.struct("attempt", "gender").alias("v"))
    says_all = F.lit(None).cast("map<string,struct<attempt:int,gender:string>>")
    if changed is not None and changed.count() <= TOLD_UNITS:
        docs = docs.withColumn(told, changed.agg(F.map_from_entries(F.collect_list(entry))).scalar())
        says_all = F.col(told)
    elif changed is not None:  # rows that hold such a unit get a map of what the table says
        docs = checkpointed(docs.withColumn(ids, F.monotonically_increasing_id()))
        holds = with_entities(docs.select(ids, t.alias("text")), F.col("text"), e, pattern, known).select(ids, F.explode_outer(e).alias("e")).where("e is not null")
        holds = holds.select(ids, F.explode(units(F.col("e"), kind_of(F.col("e")))).alias("u")).select(ids, "u.kind", "u.canon").distinct()
        maps = holds.join(changed, ["kind", "canon"]).groupBy(ids).agg(F.map_from_entries(F.collect_set(entry)).alias(told))
        docs = docs.join(maps, ids, "left").drop(ids)
        says_all = F.col(told)

    def streamed(u: Column) -> Column:
        says = F.element_at(says_all, name(u))
        attempt = F.coalesce(says["attempt"], F.lit(0))
        return F.struct(u["kind"].alias("kind"), u["canon"].alias("canon"), F.coalesce(says["gender"], u["hint"]).alias("gender"), attempt.alias("attempt"), _stream(key, u["kind"], u["canon"], attempt).alias("h"))

    # step by step, each in a column of its own, so that no expression is planned or evaluated twice
    out = with_entities(docs, t, e, pattern, known)
    out = out.withColumn(k, F.transform(e, kind_of))
    out = out.withColumn(u, F.zip_with(e, k, lambda e, k: F.transform(units(e, k), streamed)))
    out = out.withColumn(s, F.transform(u, lambda us: F.transform(us, lambda u: unit_surrogate(u["kind"], u["canon"], u["gender"], u["attempt"], u["h"], key))))
    out = out.withColumn(r, F.transform(F.arrays_zip(F.col(e).alias("e"), F.col(k).alias("k"), F.col(s).alias("s")), lambda z: _whole(z["e"], z["k"], z["s"])))
    some = F.size(e) > 0
    out = out.withColumn(pieces, F.when(some & F.col(pattern).isNotNull(), F.split(t, F.col(pattern), -1)).when(some, F.split(t, ANY, -1)))
    new = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(r, F.slice(pieces, F.lit(2), F.greatest(F.size(r), F.lit(0))), lambda r, p: F.concat(r, p)), ""))
    out = out.withColumn(text, F.when(some, new).otherwise(t)).withColumn("n_replaced", F.when(some, F.size(e)).otherwise(0))
    return out.drop(e, pattern, known, k, u, s, r, pieces, told)


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    return with_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
