"""Format-preserving pseudonyms for personal data, as keyed Feistel permutations in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that both halves end where they began
DRAWS = 8  # digits that a hash moves, by 32 bits each
RUN = 256  # values of a text that are chosen in one list
KEY = "agoralytics"  # for samples and tests; production passes its own

# The forms that are recognised, each standing alone between other characters.
# Every place where one can start is tried, and there the match and what its words begin with;
# from left to right, the first one that is also valid counts. Repeats are bounded, as in the standards,
# or of one class of characters, so that a text of any length takes time in proportion and no deep stack.
FORMS = {
    "email": r"[\p{L}\p{N}_][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,16}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}",
    "card": r"\d{4}(?:[ -]?\d{4}){3}[ -]\d{1,3}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19}",
}
SECRET = r"""(?i:password|passwd|token|secret|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_-]{8,}"""
_SECRET_NAME = r"""^.*?[=:]\s{0,3}["']?"""
# A name that is a plain word and a value that could be the next word of a sentence.
_PROSE = r"(?i:token|secret)\s{0,3}:\s{0,3}[a-z]+"
HEX_SECRET = r"[0-9a-f]{32,}|[0-9A-F]{32,}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Four hundred years of the calendar are 146,097 days, 27 times 5,411.
FIRST_DAY, CYCLE = "1800-01-01", (27, 5411)


def _unnumbered(pattern: str) -> str:
    """The date forms without back references, which would shift inside the joined pattern."""
    return pattern.replace(r"([-/.])", "[-/.]").replace(r"\1", "[-/.]").replace(r"\2", "[-/.]")


# An empty match at each start, with what matches there as the first group. A secret's name may end a longer one.
STARTS = (
    rf"(?=({SECRET}(?![\p{{L}}\p{{N}}_])|(?<![\p{{L}}\p{{N}}_])(?:"
    + "|".join([*map(_unnumbered, FORMS.values()), HEX_SECRET])
    + r")(?![\p{L}\p{N}_])))"
)
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_LAWFUL = "^(?:" + "|".join(f"{c}{n}" for n, names in IBAN_LENGTHS.items() for c in names.split()) + ")$"
# Whatever matches holds a digit, the mark of an address or of a secret, or is hexadecimal letters alone.
MAY_MATCH = "[0-9@=:]|[a-f]{32}|[A-F]{32}"


def feistel(digits: Column, radices: Column, tweak: Column, key: str) -> Column:
    """Permute mixed-radix ``digits``: every round moves one half by a keyed hash of the other.

    Digit ``j`` moves modulo its own radix, so the result has the same form, and the rounds can
    be run backwards by anyone who holds the key. A single digit has no other half: it takes
    its place among the values of its radix sorted by keyed hash.
    """
    n = F.size(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(
        F.slice(digits, 1, half).alias("a"),
        F.slice(radices, 1, half).alias("ra"),
        F.slice(digits, half + 1, n - half).alias("b"),
        F.slice(radices, half + 1, n - half).alias("rb"),
    )

    def turn(s: Column, r: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(s["b"].cast("array<string>"), ","))

        def block(seed: Column, k: Column) -> Column:
            return F.sha2(F.concat_ws("|", seed, k.cast("string")), 256)

        def moved(blocks: Column) -> Column:
            def move(x: Column, j: Column) -> Column:
                drawn = F.substr(F.get(blocks, F.floor(j / DRAWS).cast("int")), j % DRAWS * 8 + 1, F.lit(8))
                return ((x + F.conv(drawn, 16, 10).cast("bigint")) % F.get(s["ra"], j)).cast("int")

            return F.transform(s["a"], move)

        # The other half is hashed once a round, each hash of that serves several digits.
        hashed = _let(
            F.sha2(text, 256),
            lambda seed: F.transform(F.sequence(F.lit(0), F.floor(n / DRAWS).cast("int")), lambda k: block(seed, k)),
        )
        return F.struct(s["b"].alias("a"), s["rb"].alias("ra"), _let(hashed, moved).alias("b"), s["ra"].alias("rb"))

    def sorted_values(radix: Column) -> Column:
        def keyed(v: Column) -> Column:
            return F.struct(F.sha2(F.concat_ws("|", F.lit(key), tweak, radix.cast("string"), v.cast("string")), 256), v.cast("int").alias("v"))

        return F.array_sort(F.transform(F.sequence(F.lit(0), radix - 1), keyed))

    alone = F.array(F.element_at(sorted_values(radices[0]), digits[0] + 1)["v"])
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.when(n == 1, alone).otherwise(rounds)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_text(text: Column, kind: Column, key: str) -> Column:
    """Permute digits among digits and letters within their case; other characters stay.

    A secret that is wholly hexadecimal, in one case, stays so.
    """
    secret = kind == "secret"
    lower, upper = secret & text.rlike("^[0-9a-f]+$"), secret & text.rlike("^[0-9A-F]+$")
    of_text = F.when(lower, _DIGITS + _LOWER[:6]).when(upper, _DIGITS + _UPPER[:6])

    def alphabet(c: Column, whole: Column) -> Column:
        return (
            F.when(whole.isNotNull(), whole)
            .when(c.between("0", "9"), _DIGITS)
            .when(c.between("a", "z"), _LOWER)
            .when(c.between("A", "Z"), _UPPER)
            .otherwise(c)
        )

    def moved(s: Column) -> Column:
        digits = feistel(
            F.zip_with(s["chars"], s["alphabets"], lambda c, a: (F.position(c, a) - 1).cast("int")),
            F.transform(s["alphabets"], F.length),
            kind,
            key,
        )
        return F.array_join(F.zip_with(s["alphabets"], digits, lambda a, d: F.substr(a, d + 1, F.lit(1))), "")

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    listed = _let(
        F.struct(chars.alias("chars"), of_text.alias("whole")),
        lambda s: F.struct(s["chars"], F.transform(s["chars"], lambda c: alphabet(c, s["whole"])).alias("alphabets")),
    )
    return F.when(F.length(text) > 0, _let(listed, moved)).otherwise(text)


def _digits(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c != "").cast("array<int>")


def luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits, from the right every second one doubled and reduced, modulo 10."""

    def value(d: Column, j: Column) -> Column:
        return F.when(j % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(digits), value), F.lit(0), lambda a, d: (a + d) % 10)


def iban_remainder(text: Column) -> Column:
    """Remainder modulo 97 of an IBAN with its first four characters moved behind, A = 10 to Z = 35."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(_DIGITS + _UPPER)) - 1
    )
    return F.aggregate(
        values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    )


def _iso_date(m: Column) -> Column:
    """A date as year, month, day: the year first, else the day, or the month where the second number is above 12."""
    swapped = F.substr(m, F.lit(4), F.lit(2)).try_cast("int") > 12
    return (
        F.when(m.rlike(r"^\d{4}"), F.regexp_replace(m, r"^(\d+).(\d+).(\d+)$", "$1-$2-$3"))
        .when(swapped, F.regexp_replace(m, r"^(\d+).(\d+).(\d+)$", "$3-$1-$2"))
        .otherwise(F.regexp_replace(m, r"^(\d+).(\d+).(\d+)$", "$3-$2-$1"))
    )


def _day(m: Column) -> Column:
    """Days since the first day of the cycle; null where the text is no date of it."""
    days = F.date_diff(_iso_date(m).try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when((days >= 0) & (days < CYCLE[0] * CYCLE[1]), days)


def kind_of(m: Column) -> Column:
    """The kind of value that a text is, as a whole and valid; null if none."""

    def whole(kind: str) -> Column:
        return m.rlike(f"^(?:{FORMS[kind]})$")

    octets_valid = F.forall(F.split(m, r"\.").try_cast("array<int>"), lambda o: o < 256)
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)) for k in (1, 2, 3))
    issued = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return (
        F.when(m.rlike(f"^(?:{SECRET})$"), F.when(~m.rlike(f"^(?:{_PROSE})$"), "secret"))
        .when(whole("email"), "email")
        .when(whole("iban") & (iban_remainder(m) == 1), "iban")
        .when(whole("date") & _day(m).isNotNull(), "date")
        .when(whole("ip") & octets_valid, "ip")
        .when(whole("ssn") & issued, "ssn")
        .when(whole("card") & (luhn_sum(_digits(m)) == 0), "card")
        .when(whole("phone"), "phone")
        .when(m.rlike(f"^(?:{HEX_SECRET})$"), "hex")
    )


def valid_part(m: Column) -> Column:
    """``struct(text, kind)`` of the match, or of what it begins with up to a space or dash; null if nothing is valid.

    An IBAN of its country's length comes first, then the longest.
    """
    words = F.split(m, "[ -]")
    begun = F.transform(
        F.sequence(F.size(words), F.lit(1), F.lit(-1)),
        lambda k: F.substr(m, F.lit(1), F.length(F.array_join(F.slice(words, 1, k), " "))),
    )

    def lawful(p: Column) -> Column:
        sized = F.concat(F.substr(p, F.lit(1), F.lit(2)), F.length(F.regexp_replace(p, " ", "")).cast("string"))
        return p.rlike(f"^(?:{FORMS['iban']})$") & sized.rlike(_LAWFUL)

    def known(p: Column) -> Column:
        return F.struct(p.alias("text"), kind_of(p).alias("kind"))

    ordered = _let(begun, lambda b: F.concat(F.filter(b, lawful), b))
    return F.try_element_at(F.filter(F.transform(ordered, known), lambda v: v["kind"].isNotNull()), F.lit(1))


def _of_characters(m: Column, kind: Column, key: str) -> Column:
    """What stands for a value that is permuted by its characters.

    Names of secrets, mail domains, country codes of telephones and of accounts stay. The
    check digits of cards and accounts are computed anew.
    """
    dialled = r"^(?:\+\d{1,3})?"
    parts = F.struct(
        F.when(kind == "secret", F.regexp_extract(m, _SECRET_NAME, 0))
        .when(kind == "phone", F.regexp_extract(m, dialled, 0))
        .when(kind == "iban", F.substr(m, F.lit(1), F.lit(2)))
        .otherwise("")
        .alias("head"),
        F.when(kind == "secret", F.regexp_replace(m, _SECRET_NAME, ""))
        .when(kind == "phone", F.regexp_replace(m, dialled, ""))
        .when(kind == "iban", F.substr(m, F.lit(5)))
        .when(kind == "email", F.regexp_extract(m, "^[^@]*", 0))
        .when(kind == "card", F.substr(m, F.lit(1), F.length(m) - 1))
        .otherwise(m)
        .alias("body"),
        F.when(kind == "email", F.regexp_extract(m, "@.*$", 0)).otherwise("").alias("tail"),
    )

    def joined(s: Column) -> Column:
        checks = F.lpad((98 - iban_remainder(F.concat(s["head"], F.lit("00"), s["body"]))).cast("string"), 2, "0")
        check = ((10 - luhn_sum(F.concat(_digits(s["body"]), F.array(F.lit(0))))) % 10).cast("string")
        return (
            F.when(kind == "iban", F.concat(s["head"], checks, s["body"]))
            .when(kind == "card", F.concat(s["body"], check))
            .otherwise(F.concat(s["head"], s["body"], s["tail"]))
        )

    tweak = F.when(kind == "hex", "secret").otherwise(kind)
    permuted = _let(
        parts, lambda s: F.struct(s["head"], permute_text(s["body"], tweak, key).alias("body"), s["tail"])
    )
    return _let(permuted, joined)


def _of_numbers(m: Column, kind: Column, key: str) -> Column:
    """What stands for a value that is permuted by its numbers.

    Octets of addresses keep their number of digits. Social security numbers that were issued
    map to such: area 1 to 899 without 666, group and serial not zero. Dates keep their order
    and mark.
    """
    octets = F.split(m, r"\.").try_cast("array<int>")
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).try_cast("int") for k in (1, 2, 3))

    def base(o: Column) -> Column:
        return F.when(o < 10, 0).when(o < 100, 10).otherwise(100)

    def numbers(digits: Column, radices: Column) -> Column:
        return F.struct(digits.cast("array<int>").alias("digits"), radices.cast("array<int>").alias("radices"))

    days = _day(m)
    chosen = (
        F.when(
            kind == "ip",
            numbers(
                F.transform(octets, lambda o: o - base(o)),
                F.transform(octets, lambda o: F.when(o < 10, 10).when(o < 100, 90).otherwise(156)),
            ),
        )
        .when(
            kind == "ssn",
            numbers(
                F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1),
                F.array(F.lit(898), F.lit(99), F.lit(9999)),
            ),
        )
        .otherwise(numbers(F.array(F.floor(days / CYCLE[1]), days % CYCLE[1]), F.array(*map(F.lit, CYCLE))))
    )

    def padded(n: Column, width: Column | int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    def date(d: Column) -> Column:
        iso = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), d[0] * CYCLE[1] + d[1]), "yyyy-MM-dd")
        later = F.substr(m, F.lit(3), F.lit(1))

        def marked(mark: Column, *order: int) -> Column:
            return F.regexp_replace(iso, F.lit(r"^(\d+)-(\d+)-(\d+)$"), F.concat_ws("", F.lit(f"${order[0]}"), mark, F.lit(f"${order[1]}"), mark, F.lit(f"${order[2]}")))

        return (
            F.when(m.rlike(r"^\d{4}"), marked(F.substr(m, F.lit(5), F.lit(1)), 1, 2, 3))
            .when(F.substr(m, F.lit(4), F.lit(2)).try_cast("int") > 12, marked(later, 2, 3, 1))
            .otherwise(marked(later, 3, 2, 1))
        )

    def joined(d: Column) -> Column:
        widths = F.transform(F.split(m, r"\."), F.length)
        moved = F.zip_with(d, octets, lambda x, o: x + base(o))
        return (
            F.when(kind == "ip", F.array_join(F.zip_with(moved, widths, padded), "."))
            .when(
                kind == "ssn",
                F.concat_ws("-", padded(d[0] + 1 + (d[0] >= 665).cast("int"), 3), padded(d[1] + 1, 2), padded(d[2] + 1, 4)),
            )
            .otherwise(date(d))
        )

    return _let(_let(chosen, lambda s: feistel(s["digits"], s["radices"], kind, key)), joined)


def pseudonym(found: Column, key: str) -> Column:
    """What stands for a value ``struct(text, kind)``: of the same form and validity."""
    m, kind = found["text"], found["kind"]
    return F.when(kind.isin("ip", "ssn", "date"), _of_numbers(m, kind, key)).otherwise(_of_characters(m, kind, key))


def pseudonymised(text: Column, key: str) -> Column:
    """``struct(text, found, given)``: the text with pseudonyms, what was replaced and by what."""
    starts = F.struct(
        F.split(text, STARTS).alias("pieces"), F.regexp_extract_all(text, F.lit(STARTS), F.lit(1)).alias("matches")
    )

    def tried(s: Column) -> Column:
        """Per piece of the text the valid value that starts with it; the first piece may have none."""
        lead = F.size(s["pieces"]) > F.size(s["matches"])
        matches = F.when(lead, F.concat(F.array(F.lit("")), s["matches"])).otherwise(s["matches"])
        return F.zip_with(s["pieces"], matches, lambda p, m: F.struct(p.alias("piece"), valid_part(m).alias("found")))

    value = "struct<text:string,kind:string>"

    def step(done: Column, x: Column) -> Column:
        """Values that start inside one that is replaced are not; its characters are left out."""
        taken = (done["hidden"] == 0) & x["found"].isNotNull()
        hidden = F.when(taken, F.length(x["found"]["text"])).otherwise(done["hidden"])
        part = F.struct(
            F.substr(x["piece"], hidden + 1).alias("rest"), F.when(taken, x["found"]).alias("found")
        )
        return F.struct(
            F.greatest(hidden - F.length(x["piece"]), F.lit(0)).alias("hidden"),
            F.concat(done["parts"], F.array(part)).alias("parts"),
        )

    def run(hidden: Column, pieces: Column) -> Column:
        none = F.array().cast(f"array<struct<rest:string,found:{value}>>")
        return F.aggregate(pieces, F.struct(hidden.alias("hidden"), none.alias("parts")), step)

    def chosen(pieces: Column) -> Column:
        """What is left of each piece and the value taken there, ``RUN`` pieces at a time.

        A list is copied whenever it grows, so a text with many values gets a list of lists.
        """

        def more(done: Column, k: Column) -> Column:
            return _let(
                run(done["hidden"], F.slice(pieces, k * RUN + 1, RUN)),
                lambda r: F.struct(r["hidden"], F.concat(done["runs"], F.array(r["parts"])).alias("runs")),
            )

        none = F.array().cast(f"array<array<struct<rest:string,found:{value}>>>")
        starts = F.sequence(F.lit(0), F.floor(F.size(pieces) / RUN).cast("int"))
        return F.flatten(F.aggregate(starts, F.struct(F.lit(0).alias("hidden"), none.alias("runs")), more)["runs"])

    def given(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda p: F.struct(
                p["rest"].alias("rest"),
                p["found"]["text"].alias("found"),
                F.when(p["found"].isNotNull(), pseudonym(p["found"], key)).alias("given"),
            ),
        )

    def rebuilt(parts: Column) -> Column:
        changed = F.transform(
            F.filter(parts, lambda p: p["found"] != p["given"]),
            lambda p: F.struct(p["found"].alias("found"), p["given"].alias("given")),
        )
        pieces = F.transform(parts, lambda p: F.concat(F.coalesce(p["given"], F.lit("")), p["rest"]))
        return F.struct(F.array_join(pieces, "").alias("text"), changed.alias("changed"))

    empty = F.array().cast("array<struct<found:string,given:string>>")
    return F.when(
        text.rlike(MAY_MATCH), _let(_let(_let(starts, tried), lambda x: given(chosen(x))), rebuilt)
    ).otherwise(F.struct(text.alias("text"), empty.alias("changed")))


def replace_personal_data(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with pseudonyms in ``text_col``: one expression over each row."""
    text = F.col(text_col).cast("string")
    return docs.withColumn(text_col, pseudonymised(text, key)["text"])


def pseudonymise(
    docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text, n_pseudonyms, pseudonyms`` for every row of ``docs``.

    Card numbers (Luhn), IBANs (modulo 97), social security numbers, IPv4 addresses, calendar
    dates, telephone numbers, local parts of e-mail addresses, and secrets (long hexadecimal
    strings, or what follows a name such as ``password=``) are permuted within their format by
    a Feistel network keyed with ``key``: valid values map to valid ones, one to one, and equal
    values to equal pseudonyms in all documents. Values that fail validation stay. A
    permutation may leave a few values as they are; ``pseudonyms`` lists those that changed. A
    ``token:`` or ``secret:`` before a word of lower-case letters alone reads as prose and stays.

    Dates move within the 400 years from 1800; dates outside stay. A null text stays null;
    repeated rows each return; an empty table gives no rows; other columns are ignored. There
    is no shuffle and no Python: everything is one projection over the rows read.
    """
    text = F.col(text_col).cast("string")
    done = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), pseudonymised(text, key).alias("done"))
    return done.select(
        "doc_id",
        "done.text",
        F.size("done.changed").cast("bigint").alias("n_pseudonyms"),
        F.col("done.changed.given").alias("pseudonyms"),
    )
