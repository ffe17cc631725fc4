"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern, brought to a canonical form and replaced by surrogates of the same type, drawn from a
keyed hash (HMAC-SHA256 of the caller's key): digits by digits in the same layout, letters by letters of the same case,
card numbers and IBANs with right check digits, addresses in reserved domains, names of the same gender and script. One
entity has one surrogate everywhere in the corpus (coreference). All distinct entities are then checked: where a
surrogate meets another one, or equals a real entity, it is drawn again (distinctness). What still collides after
MAX_DRAWS draws gets a number of its own, which is written into its surrogate, so that even full spaces (one-letter
mailboxes, 192.168.x.y) have values for all.

A name is found by its title (Latin and Cyrillic script). It is two entities: the family name, and the given names
within that family; so the Smiths of a corpus keep one family name. In a text with a titled name, its mentions without
title are replaced too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import broadcast_if_small, materialize

#: Draws from hashes; from there on, draw - MAX_DRAWS is a number that no other entity has.
MAX_DRAWS = 12
#: Between rounds of numbers, the next one grows by this factor, so that dense ranges of real entities are soon left.
LEAP = 16
#: Up to so many redrawn entities are held in one map; more are joined to the texts that mention them.
MAX_MAP = 1000

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,63}(?![\p{L}\p{N}-])"  # names have 127 labels at most
SECRET = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}+={0,2}"
#: Keys and tokens that are known by their first characters.
TOKEN_HEAD = "(?:sk-|gh[opsru]_|xox[abprs]-|eyJ)"
TOKEN = r"(?<![A-Za-z0-9_-])(?:sk-[A-Za-z0-9_-]{16,}+|gh[opsru]_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
AWS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
#: Eight groups of hexadecimal digits, or fewer around one ::.
GROUP6 = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[A-Fa-f:]{{0,39}}\d)(?:(?:{GROUP6}:){{7}}{GROUP6}|(?:{GROUP6}:){{1,6}}(?::{GROUP6}){{1,6}}|(?:{GROUP6}:){{2,7}}:|::(?:{GROUP6}:){{1,6}}{GROUP6})(?![\w:.]*\w)"
CARD = r"(?<![\d-])(?:[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])"
#: A number of nine digits or more within a country: area code, a blank or slash, groups.
NATIONAL = r"(?<![\w+.,:/-])(?=0\d{1,4}[ /](?: ?\d){5,10}(?![\d,.:/-]*\d))(?=(?:[ /]?\d){9,12}(?!\d))0\d{1,4}[ /]\d{2,8}(?: \d{2,4}){0,4}(?![ /]?\d)"
#: Titles by gender; a name has up to WORDS capitalised words after its titles, with hyphens and apostrophes, particles and
#: initials before them. (The engine's stack bounds the words, not what names have.)
WORDS = 30
HE = "Mr|Mister|Herr|Señor|Sr|Monsieur|Signor|господин|г-н"
SHE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Srta|Madame|Mademoiselle|Mme|Mlle|Signora|госпожа|г-жа"
BOTH = "Dr|Prof|Professor|Doctor|доктор|профессор"
TITLES = f"(?:{HE}|{SHE}|{BOTH})"
#: What stands in small letters between given names and a family name.
PARTICLE = "(?:van|von|vom|zu|zum|zur|der|den|ter|ten|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn)"
PART = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{Ll}\p{L}*+(?:[-'’]\p{Lu}\p{L}++){0,8}|\p{Lu}{2,}+)(?!\p{L})"
BEFORE = rf"(?:{PARTICLE} |\p{{Lu}}\. ?){{0,6}}"
NAME = rf"(?<![\p{{L}}])(?:{TITLES}\.? ){{1,6}}{BEFORE}{PART}(?: {BEFORE}{PART}){{0,{WORDS - 1}}}"
#: Each alternative after a look at its first characters, so that most positions fail at once.
ANY = "|".join((f"(?=[^\\s@]){EMAIL}", f"(?=[pPsStTaA]){SECRET}", f"(?=AKIA){AWS}", f"(?=[sgxe]){TOKEN}", f"(?=[DFHMPSгдп]){NAME}", rf"(?=[A-Z]{{2}}\d){IBAN}", rf"(?=\d){SSN}", f"(?=[3-6]){CARD}", rf"(?=\d){IP}", rf"(?=[+(\d])(?:{PHONE})", f"(?=0){NATIONAL}", f"(?=[0-9A-Fa-f:]{{1,5}}:){IP6}"))

#: First names by gender (u: either) and script, and syllables of which family names are made.
FIRST = {
    ("m", "latin"): "adam bruno carl david erik felix georg hugo ivan jonas karl leon marco nils oscar paul".split(),
    ("f", "latin"): "anna berta clara diana elena flora greta helen irene julia karin laura maria nora olga paula".split(),
    ("u", "latin"): "alex robin kim sascha noel toni charlie dominique jean jo luca marian nikita quinn sam val".split(),
    ("m", "cyrillic"): "антон борис виктор глеб денис егор игорь олег".split(),
    ("f", "cyrillic"): "анна вера дарья елена ирина ольга софья юлия".split(),
    ("u", "cyrillic"): "саша женя валя слава".split(),
}
SYLLABLES = {"latin": "ba do fe gi ka lo mi na pe ro sa ti ve wi za lu".split(), "cyrillic": "ба до ве ги ка ло ми на пе ро са ти бу зе ра лу".split()}
#: First names that tell the gender where the title doesn't, beside those of FIRST.
KNOWN = {
    "m": "john james robert michael william thomas george peter hans klaus wolfgang pierre michel luis carlos josé juan antonio сергей иван алексей".split(),
    "f": "mary linda susan sarah emma jennifer elizabeth ursula sabine monika marie sophie claire carmen ana lucía maría isabel мария наталья татьяна".split(),
}


def chars(s: Column) -> Column:
    return F.sequence(F.lit(1), F.length(s))


def byte(h: Column, i: Column | int) -> Column:
    """The i-th byte of a hex digest, beginning anew after 32."""
    at = (F.lit(i) if isinstance(i, int) else i) - 1
    return F.conv(F.substring(h, (F.pmod(at, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pick(values: str | list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def like(s: Column, h: Column, signs: bool = False) -> Column:
    """Every digit and ASCII letter of s by another of its kind; hexadecimal strings stay hexadecimal. With signs, - and _
    are replaced by one of the two as well, and so are + and /."""
    hexadecimal = s.rlike("^[0-9a-f]*[a-f][0-9a-f]*$")

    def one(i: Column) -> Column:
        c, b = F.substring(s, i, F.lit(1)), byte(h, i)
        out = F.when(hexadecimal, pick("0123456789abcdef", b)).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", b))
        return (out.when(c.rlike("[-_]"), pick("-_", b)).when(c.rlike("[+/]"), pick("+/", b)) if signs else out).otherwise(c)

    return F.array_join(F.transform(chars(s), one), "")


def padded(n: Column, width: Column | int) -> Column:
    """A number with zeros before it up to width; all of its digits where it has more."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width) if isinstance(width, int) else width), F.lit("0"))


def poured(digits: Column, layout: Column) -> Column:
    """layout with its digits replaced, in order, by those of digits; digits that it has no place for follow."""

    def one(i: Column) -> Column:
        c = F.substring(layout, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(layout, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(layout, "[^0-9]", ""))
    return F.concat(F.array_join(F.transform(chars(layout), one), ""), F.substring(digits, places + 1, F.length(digits)))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum; shift 0 if the last digit is the check digit, 1 if it is still to come."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i + shift) % 2 == 1
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(chars(digits), F.lit(0), add)


def remainder97(code: Column) -> Column:
    """The number that an IBAN's characters spell (A is 10, Z is 35), modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(code, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (total * 10 + F.when(c.rlike("[0-9]"), c).otherwise("0").cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars(code), F.lit(0), add)


def kind_of(m: Column) -> Column:
    """Type of a match; null for what only looks like an entity (wrong check digits)."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    plain = F.regexp_replace(m, " ", "")
    iban = remainder97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^{AWS}$"), "aws").when(m.rlike(f"^{TOKEN}$"), "token").when(m.rlike(f"^{IP6}$"), "ip6").when(m.rlike("^(?i:password|passwd|pwd|secret|token|api)"), "secret")
        .when(m.rlike(rf"^(?:{HE})\.? "), "name_m").when(m.rlike(rf"^(?:{SHE})\.? "), "name_f").when(m.rlike(rf"^(?:{BOTH})\.? "), "name_u").when(m.rlike("^[A-Z]{2}"), F.when(iban, "iban"))
        .when(m.rlike(f"^{SSN}$"), "ssn").when(m.rlike(f"^(?:{CARD})$"), F.when(luhn_sum(digits, 0) % 10 == 0, "card")).when(m.rlike(f"^{IP}$"), "ip").otherwise("phone")
    )


SECRET_HEAD = r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
TITLE = rf"^(?:{TITLES}\.? )+"


def canonical(m: Column, kind: Column) -> Column:
    """What two mentions of one entity share: small letters of addresses and names, digits of numbers, a secret's value."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(m)).when(kind == "secret", F.regexp_replace(m, SECRET_HEAD, "")).when(kind.startswith("name"), F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, TITLE, ""), rf"(?<!\p{{L}}){PARTICLE} ", ""), r"(\p{Lu}\.)(?! )", "$1 ")))
        .when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), digits)).when(kind.isin("card", "ssn"), digits).when(kind == "ip6", F.lower(m)).otherwise(m)
    )


def keyed(key: bytes) -> Callable[..., Column]:
    """HMAC-SHA256 with key, as a function of columns to a hex digest."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))

    def digest(*parts: Column) -> Column:
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat_ws("|", *parts).cast("binary")), 256))), 256)

    return digest


def family_of(kind: Column, c: Column) -> Column:
    """The family name of a name's canonical form; a Russian woman's without its ending."""
    last = F.regexp_extract(c, r"(\S+)$", 1)
    return F.when((kind == "name_f") & last.rlike(r"\p{IsCyrillic}{2}а$"), F.regexp_replace(last, "а$", "")).otherwise(last)


def given_kind(kind: Column, c: Column) -> Column:
    """given_m, given_f or given_u: by the first name where it is known, else by the title."""
    first = F.substring_index(c, " ", 1)
    known = {g: [*KNOWN[g], *FIRST[g, "latin"], *FIRST[g, "cyrillic"]] for g in "mf"}
    return F.when(first.isin(known["m"]), "given_m").when(first.isin(known["f"]), "given_f").otherwise(F.concat(F.lit("given_"), F.substring(kind, -1, 1)))


def given_of(kind: Column, c: Column) -> Column:
    """The given names within their family."""
    return F.concat(F.regexp_replace(c, r"\s*\S+$", ""), F.lit("|"), family_of(kind, c))


def entities_of(x: Column) -> Column:
    """array<struct<kind, c>>: what a mention stands for."""
    one = lambda kind, c: F.array(F.struct(kind.alias("kind"), c.alias("c")))
    kind, c = x["kind"], x["c"]
    family = one(F.lit("family"), family_of(kind, c))
    name = F.when(c.contains(" "), F.concat(family, one(given_kind(kind, c), given_of(kind, c)))).otherwise(family)
    return F.when(kind.startswith("name"), name).when(kind.isNotNull(), one(kind, c))


def surrogate_core(kind: Column, c: Column, draw: Column, key: bytes) -> Column:
    """The surrogate's canonical form: a function of type, canonical form, draw and key alone. From MAX_DRAWS on it holds
    the number draw - MAX_DRAWS: in place of digits where it fits, else in a longer form (addresses: a wider range)."""
    digest = keyed(key)
    at = F.substring_index(c, "@", -1)
    given = F.struct(
        kind.alias("kind"), c.alias("c"), draw.cast("long").alias("draw"), digest(kind, c, draw.cast("string")).alias("h"),
        F.regexp_replace(c, "[^0-9]", "").alias("digits"), F.when(kind == "email", digest(F.lit("domain"), at)).alias("domain"),
    )
    return let(given, _by_kind)


def _by_kind(x: Column) -> Column:
    kind, c, h, digits, domain = (x[k] for k in ("kind", "c", "h", "digits", "domain"))
    wide, n = x["draw"] >= MAX_DRAWS, x["draw"] - MAX_DRAWS

    def added(x: Column) -> Column:
        return F.when(wide, x).otherwise("")

    def ending(s: Column, length: Column, width: Column | int) -> Column:
        """s, of that length, its last characters replaced by the number."""
        return F.concat(F.substring(s, F.lit(1), length - F.when(wide, width).otherwise(0)), added(padded(n, width)))

    def drawn(keep: int | Column) -> Column:
        return F.array_join(F.transform(chars(digits), lambda i: F.when(i <= keep, F.substring(digits, i, F.lit(1))).when(i == keep + 1, (2 + byte(h, i) % 8).cast("string")).otherwise((byte(h, i) % 10).cast("string"))), "")

    def numbers(keep: int | Column) -> Column:
        return ending(drawn(keep), F.length(digits), F.length(digits) - F.greatest(F.lit(1), F.lit(keep) if isinstance(keep, int) else keep))

    # Digits of a country's calling code, a fixed rule: 1 and 7 stand alone, the codes listed have two, all others three.
    calling = F.when(digits.rlike("^[17]"), 1).when(digits.rlike("^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), 2).otherwise(3)

    email = F.concat(like(F.substring_index(c, "@", 1), h), added(F.concat(F.lit("."), n.cast("string"))), F.lit("@"), *[pick("abcdefghijklmnopqrstuvwxyz", byte(domain, i)) for i in range(1, 8)], F.lit(".example.com"))
    card = let(ending(drawn(1), F.length(digits) - 1, 10), lambda body: F.concat(body, ((10 - luhn_sum(body, 1) % 10) % 10).cast("string")))
    inside = F.when(c.rlike(r"^10\."), "10").when(c.rlike(r"^127\."), "127").when(c.rlike(r"^192\.168\."), "192.168")
    ip = F.when(c.rlike(r"^192\.168\."), F.concat_ws(".", inside, byte(h, 2).cast("string"), byte(h, 3).cast("string"))).otherwise(F.concat_ws(".", F.coalesce(inside, (240 + byte(h, 1) % 15).cast("string")), *[byte(h, k).cast("string") for k in (2, 3, 4)]))
    part = lambda k: (F.shiftright(n, k) % 256).cast("string")
    reserved = F.when(c.rlike(r"^(10|192\.168)\.") & (n < 1 << 24), F.concat_ws(".", F.lit("10"), part(16), part(8), part(0))).when(n < 1 << 28, F.concat_ws(".", (240 + F.shiftright(n, 24)).cast("string"), part(16), part(8), part(0)))
    ip = F.when(wide, F.coalesce(reserved, F.concat(F.lit("2001:db8::"), *[x for k in (48, 32, 16, 0) for x in (F.lower(F.hex(F.shiftright(n, k) % 65536)), F.lit(":" if k else ""))]))).otherwise(ip)
    long6 = lambda *words: F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.lower(F.hex(w))) for w in words])
    drawn6 = long6(*[byte(h, 2 * k + 1) * 256 + byte(h, 2 * k + 2) for k in range(6)])
    ip6 = F.when(wide, long6(F.lit(0), F.lit(0), *[F.shiftright(n, k) % 65536 for k in (48, 32, 16, 0)])).otherwise(drawn6)
    head = F.regexp_extract(c, f"^{TOKEN_HEAD}", 0)
    token = F.concat(head, like(F.substring(c, F.length(head) + 1, F.length(c)), h, signs=True), added(n.cast("string")))
    country = F.substring(c, 1, 2)
    checked = lambda rest: F.concat(country, F.lpad((98 - remainder97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    iban = let(ending(like(F.substring(c, F.lit(5), F.length(c)), h), F.length(c) - 4, 10), checked)
    cyrillic = c.rlike(r"\p{IsCyrillic}")
    figure = lambda i: F.conv(F.substring(F.hex(n), i, F.lit(1)), 16, 10).cast("int")
    spell = lambda s: lambda i: pick(SYLLABLES[s], figure(i))
    spelled = {s: added(F.array_join(F.transform(chars(F.hex(n)), spell(s)), "")) for s in SYLLABLES}
    last = {s: F.concat(*[pick(SYLLABLES[s], byte(h, i)) for i in range(1, 5)], spelled[s], F.lit("н" if s == "cyrillic" else "n")) for s in SYLLABLES}
    family = F.when(cyrillic, last["cyrillic"]).otherwise(last["latin"])

    def first(i: int) -> Column:
        by_kind = F.lit(None).cast("string")
        for (g, script), names in FIRST.items():
            by_kind = F.when((kind == f"given_{g}") & (cyrillic == (script == "cyrillic")), pick(names, byte(h, i))).otherwise(by_kind)
        return by_kind

    short = F.substring_index(c, "|", 1).rlike(r"^\p{L}\.")  # an initial stays one
    named = F.when(short, F.concat(F.substring(first(1), 1, 1), F.lit("."))).otherwise(first(1))
    given = F.concat(named, F.when(cyrillic, spelled["cyrillic"]).otherwise(spelled["latin"]), F.when(F.substring_index(c, "|", 1).contains(" "), F.concat(F.lit(" "), first(2))).otherwise(""), F.lit("|"), F.substring_index(c, "|", -1))
    return (
        F.when(kind == "email", email).when(kind == "secret", F.concat(added(F.concat(n.cast("string"), F.lit("-"))), like(c, h, signs=True)))
        .when(kind == "aws", F.concat(F.lit("AKIA"), F.when(wide, F.translate(F.lpad(F.conv(n.cast("string"), 10, 32), 16, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", byte(h, i))), ""))))
        .when(kind == "family", family).when(kind.startswith("given"), given).when(kind == "iban", iban).when(kind == "ssn", F.concat(F.lit("9"), F.substring(numbers(0), 2, 64))).when(kind == "ip6", ip6).when(kind == "token", token).when(kind == "card", card).when(kind == "ip", ip)
        .otherwise(F.when(c.startswith("+"), F.concat(F.lit("+"), numbers(calling))).when(c.startswith("0"), numbers(1)).otherwise(numbers(0)))
    )


def core_of(x: Column, draw: Callable[[Column, Column], Column], key: bytes) -> Column:
    """The surrogate of a mention; draw(kind, c) is an entity's draw. Names: the given names, a blank, the family name."""
    kind, c = x["kind"], x["c"]
    made = F.transform(entities_of(x), lambda e: surrogate_core(e["kind"], e["c"], draw(e["kind"], e["c"]), key))
    ending = F.when((kind == "name_f") & c.rlike(r"\p{IsCyrillic}{2}а$"), "а").otherwise("")

    def put_together(s: Column) -> Column:
        given = F.when(F.size(s) > 1, F.concat(F.substring_index(s[1], "|", 1), F.lit(" "))).otherwise("")
        return F.when(kind.startswith("name"), F.initcap(F.concat(given, s[0], ending))).otherwise(s[0])

    return let(made, put_together)


def with_particles(m: Column, core: Column) -> Column:
    """A name's surrogate with the particles that the mention has before its last word."""
    own = F.regexp_extract(m, rf"(?:^| )((?:{PARTICLE} )+)\S+$", 1)
    return F.concat(F.regexp_extract(core, r"^(.* )?\S+$", 1), own, F.regexp_extract(core, r"(\S+)$", 1))


def in_layout(m: Column, kind: Column, core: Column) -> Column:
    """The surrogate in the layout of the mention."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), poured(F.regexp_replace(core, "[^0-9]", ""), m)).when(kind == "secret", F.concat(F.regexp_extract(m, SECRET_HEAD, 0), core))
        .when(kind.startswith("name"), F.concat(F.regexp_extract(m, TITLE, 0), with_particles(m, core))).when(kind == "iban", F.when(m.contains(" "), F.trim(F.regexp_replace(core, "(.{4})", "$1 "))).otherwise(core)).otherwise(core)
    )


def may_have(text: Column) -> Column:
    """Whether a text has a character or a title without which none of the patterns matches."""
    out = text.rlike("[0-9@=:]") | text.contains("AKIA") | text.contains("sk-") | text.contains("eyJ") | text.contains("xox") | text.contains("gh")
    for title in f"{HE}|{SHE}|{BOTH}".split("|"):
        out = out | text.contains(title)
    return out


def mentions(text: Column) -> Column:
    """array<struct<m, kind, c>> of all matches in a text, in order; kind and c are null for what isn't an entity."""
    found = F.when(may_have(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    with_kind = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    return F.transform(with_kind, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), canonical(x["m"], x["kind"]).alias("c")))


def counted_through(rows: DataFrame, start: int, parts: int = 1024) -> DataFrame:
    """rows (kind, c) with draw: numbers from start on, each once, by parts of the rows' hash and by place in their part."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("kind", "c"), F.lit(parts)))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each part
    place = F.row_number().over(W.partitionBy("part").orderBy("kind", "c"))
    return dealt.withColumn("place", place).join(F.broadcast(offsets), "part").select("kind", "c", (F.col("before") + F.col("place") - 1 + start).cast("long").alias("draw"))


def draws(entities: DataFrame, key: bytes) -> DataFrame:
    """entities (kind, c, distinct) -> those (kind, c, draw) whose first surrogate is taken, with the draw that is free.

    Of the entities with one surrogate the smallest keeps it; the others, and those whose surrogate is itself an entity,
    draw again until nothing collides. Only the colliding ones go into a further round. From MAX_DRAWS on they are counted
    through, and each draw is a number that no entity had before: forms with it are without end."""
    real = entities.select("kind", F.col("c").alias("s"), F.lit(True).alias("real"))
    own = lambda df: df.withColumn("s", surrogate_core(F.col("kind"), F.col("c"), F.col("draw"), key)).select("kind", "c", "s", "draw")
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entities.repartition(tasks, "kind", "c").withColumn("draw", F.lit(0).cast("long"))  # small rows, long work
    given = materialize(own(dealt), "pii-given")
    settled, tested, draw, start = None, given, 0, 0
    while True:
        first = given.groupBy("kind", "s").agg(F.min(F.struct("draw", "c")).alias("first"))
        clash = tested.join(first, ["kind", "s"]).join(real, ["kind", "s"], "left").filter((F.col("first.c") != F.col("c")) | F.col("real")).select("kind", "c")
        clash = materialize(clash, "pii-clash")
        settled = tested.filter("draw > 0").join(clash, ["kind", "c"], "left_anti") if settled is None else settled.unionByName(tested.join(clash, ["kind", "c"], "left_anti"))
        if not (left := clash.count()):
            return settled.select("kind", "c", "draw")
        draw += 1
        if draw < MAX_DRAWS:
            numbered = clash.withColumn("draw", F.lit(draw).cast("long"))
        else:
            numbered = materialize(counted_through(clash, MAX_DRAWS + start), "pii-numbered")
            start = (start + left) * LEAP
        tested = materialize(own(numbered), "pii-redrawn")
        given = given.join(clash, ["kind", "c"], "left_anti").unionByName(tested)
        if draw % 4 == 0:  # plans stay short
            given, settled = materialize(given, "pii-given"), materialize(settled, "pii-settled")


def name_map(found: Column) -> Column:
    """map<string, string> of a text's titled names and their family names, as they stand without title, in capitals or with
    title in small letters, to surrogates; found: array of its mentions (m, kind, core)."""
    bare = lambda x: F.regexp_replace(x["m"], TITLE, "")
    last = lambda s: F.regexp_extract(s, r"(\S+)$", 1)
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    names = F.filter(found, lambda x: F.coalesce(x["kind"].startswith("name"), F.lit(False)))
    title = lambda x: F.regexp_extract(x["m"], TITLE, 0)

    def variants(x: Column) -> Column:
        """As written, in capitals, and in small letters where given names or the title stand before."""
        whole, family, core, new = bare(x), last(bare(x)), x["core"], last(x["core"])
        named = F.concat(title(x), family), F.concat(title(x), new)
        small = F.array(pair(F.lower(x["m"]), F.lower(F.concat(title(x), core))), *[pair(F.lower(a), F.lower(b)) for a, b in (named,)])
        full = F.when(whole.contains(" "), F.array(pair(F.lower(whole), F.lower(core)))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
        plain = F.array(pair(whole, core), pair(family, new), pair(F.upper(whole), F.upper(core)), pair(F.upper(family), F.upper(new)))
        return F.concat(plain, small, full)

    pairs = F.flatten(F.transform(names, variants))
    return F.aggregate(pairs, F.expr("cast(map() as map<string, string>)"), lambda acc, p: F.when(F.map_contains_key(acc, p["key"]), acc).otherwise(F.map_concat(acc, F.create_map(p["key"], p["value"]))))


def with_names(gap: Column, names: Column, pattern: Column) -> Column:
    """struct<text, n>: the text between mentions with untitled names replaced, and their number."""
    hits = F.regexp_extract_all(gap, pattern, F.lit(0))
    new = F.transform(hits, lambda h: F.element_at(names, h))
    text = F.array_join(F.zip_with(F.split(gap, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    return F.struct(F.when(F.size(hits) > 0, text).otherwise(gap).alias("text"), F.size(hits).alias("n"))


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of docs with text replaced, and _pii (long): the number of mentions replaced in it.

    key: the secret of which the surrogates are drawn; the same key gives the same surrogates for the same corpus. (It is
    part of the query plan: keep event logs as secret as the key.) Null texts stay null and empty ones empty, with 0
    mentions; a text without entities stays as it is; long texts are searched whole. Rows are handled by their text
    alone, so repeated rows get equal results and other columns, whatever their names, pass through (only _pii is
    replaced). An empty table gives an empty table. No input makes it fail: surrogates that run out get longer.
    """
    docs = docs.drop("_pii")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    marked = docs.select(row.alias("_row"), F.col("text").alias("_text"), mentions(F.col("text")).alias("_found"))
    all_entities = F.flatten(F.transform(F.filter("_found", lambda x: x["kind"].isNotNull()), entities_of))
    found = marked.select(F.explode(all_entities).alias("x")).select("x.kind", "x.c").distinct()
    again = materialize(draws(materialize(found, "pii-entities"), key), "pii-draws")
    name = lambda kind, c: F.concat_ws("|", kind, c)
    entry = F.struct(name(F.col("kind"), F.col("c")).alias("key"), F.col("draw").alias("value"))
    redrawn = again.limit(MAX_MAP + 1).count()
    if redrawn == 0:
        marked = marked.withColumn("_draws", F.expr("cast(null as map<string, bigint>)"))
    elif redrawn <= MAX_MAP:
        marked = marked.crossJoin(F.broadcast(again.agg(F.map_from_entries(F.collect_list(entry)).alias("_draws"))))  # one row
    else:
        text_key = F.when(F.size("_found") > 0, F.sha2(F.col("_text").cast("binary"), 256))
        pairs = marked.select(text_key.alias("_key"), F.explode(all_entities).alias("x")).select("_key", "x.kind", "x.c").distinct().join(again, ["kind", "c"])
        by_text = pairs.groupBy("_key").agg(F.map_from_entries(F.collect_list(entry)).alias("_draws"))
        marked = marked.withColumn("_own", text_key).join(broadcast_if_small(materialize(by_text, "pii-by-text")), F.col("_own") == F.col("_key"), "left")
    draw = lambda kind, c: F.coalesce(F.element_at("_draws", name(kind, c)), F.lit(0).cast("long"))
    cores = F.transform("_found", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), core_of(x, draw, key).alias("core")))
    named = F.exists("_found", lambda x: F.coalesce(x["kind"].startswith("name"), F.lit(False)))
    made = marked.select("_row", "_text", cores.alias("_cores"), named.alias("_named"))
    made = made.withColumn("_names", F.when(F.col("_named"), name_map(F.col("_cores"))))
    longest = F.array_sort(F.map_keys("_names"), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    made = made.withColumn("_pattern", F.when(F.col("_named"), pattern))
    gaps = F.split("_text", ANY, -1)
    plain = F.transform(gaps, lambda g: F.struct(g.alias("text"), F.lit(0).alias("n")))
    between = F.when(F.col("_named"), F.transform(gaps, lambda g: with_names(g, F.col("_names"), F.col("_pattern")))).otherwise(plain)
    made = made.withColumn("_gaps", F.when(F.size("_cores") > 0, between))
    new = F.transform("_cores", lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(in_layout(x["m"], x["kind"], x["core"])))
    rebuilt = F.array_join(F.zip_with("_gaps", F.concat(new, F.array(F.lit(""))), lambda g, s: F.concat(g["text"], s)), "")
    text = F.when(F.size("_cores") > 0, rebuilt).otherwise(F.col("_text"))
    untitled = F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["n"])
    count = F.when(F.size("_cores") > 0, F.size(F.filter("_cores", lambda x: x["kind"].isNotNull())) + untitled).otherwise(0).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return made.select(*columns, count.alias("_pii"))
