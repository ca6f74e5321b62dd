"""Personal data: keyed, type-consistent surrogates in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
LOCAL = r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: the start of a card as it is usually written
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)"
TITLED = r"(?<!\p{L})(?:Mrs|Mr|Miss|Ms|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Госпожа|Господин)\.? "
ASSIGNED = r"(?<![\p{L}\d])(?i:password|passwd|secret|token|api[_-]?key)\s{0,2}[=:](?!=)\s{0,2}[\"']?"
#: letters, digits and signs up to a blank, a quote or the next assignment; closing marks at the end are not part of it
SECRET = r"(?:[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}0-9_+/=!#$%*@^|~?\\-]|&(?!\w+=)|[.,;:()\[\]{}](?![\s\"'.,;:()\[\]{}<>`]|\w+=|$)){8,}+"
#: a name after a title: initials, particles and one word with any capitals; 's is not part of it
NAME = (r"(?:(?:\p{Lu}\.){1,4}+ ?|\p{Lu} |(?:van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|zur) |(?:[dl]['’]|al-|el-)){0,4}+"
        r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’-]?[\p{L}\p{M}])++")
#: fixed values: what is detected, in this order of precedence.  Runs are
#: bounded or possessive, so a long text without blanks costs linear time.
#: ``card`` is a whole run of digits up to the next number of another kind;
#: `_cards` finds the cards in it.
PATTERNS = {
    "secret": ASSIGNED + SECRET,
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ip": IP,
    "phone": (r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
              rf"|\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?(?!{IP}|{LOCAL}|{SSN}|{CARD})\d{{2,4}}){{1,3}}(?!\d)"
              r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|" + LOCAL),
    "ssn": SSN,
    "card": rf"(?<![\d-])\d(?:\d|[ -](?!{IP}|{LOCAL}|{SSN})\d){{12,}}+",
    "person": rf"{TITLED}{NAME}(?: {NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: the form of a match, for patterns that look at what follows it in the text
FORMS = {"secret": f"^{ASSIGNED}", "phone": r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$", "card": r"^\d(?:[ -]?\d){12,}+$", "person": f"^{TITLED}"}
#: fixed values: how cards are written (groups, pattern), the likeliest first; further groups may follow
CARDS = [(4, r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}"), (3, r"\d{4}([ -])\d{6}\1\d{4,5}"), (1, r"\d{13,19}"), (5, r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}")]
#: digits that may stand beside a card written in another way: expiry date and check number
BESIDE = 7
FEMALE = r"^(?:Mrs|Miss|Ms|Frau|Madame|Mme|Señora|Госпожа)"
#: fixed values: what surrogate names are built from, by script
SYLLABLES = {"lat": ("ba", "be", "da", "de", "fa", "ga", "ka", "ke", "la", "le", "ma", "me", "na", "ne", "ra", "re", "sa", "so", "ta", "vo"),
             "cyr": ("ба", "бе", "да", "де", "ва", "га", "ка", "ке", "ла", "ле", "ма", "ме", "на", "не", "ра", "ре", "са", "со", "та", "во")}
ENDS = {"given_f_lat": "lia", "given_m_lat": "ron", "given_f_cyr": "лия", "given_m_cyr": "рон",
        "surname_f_lat": "ner", "surname_m_lat": "ner", "surname_f_cyr": "нова", "surname_m_cyr": "нов"}


def _kind(m: Column) -> Column:
    """The pattern that a match comes from."""
    out = None
    for name, pattern in PATTERNS.items():
        is_it = m.rlike(FORMS.get(name, f"^(?:{pattern})$"))
        out = F.when(is_it, F.lit(name)) if out is None else out.when(is_it, F.lit(name))
    return out


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string (0 modulo 10 if its check digit is right)."""
    d = F.reverse(F.split(digits, "(?<=.)(?=.)"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, (x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")).otherwise(x.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _unit(kind: Column, canon: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"))


def _segment(m: Column, kind: str | None) -> Column:
    return F.struct(m.alias("m"), F.lit(kind).cast("string").alias("kind"))


def _joined(groups: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(groups, start + 1, n), "")


def _right(m: Column) -> Column:
    return _luhn(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0


def _cut(groups: Column, picks: Column) -> Column:
    """A run as segments: cards at ``picks(at, n)``, the first of those that
    overlap, and what lies between them."""
    none = F.array().cast("array<struct<m:string,kind:string>>")
    return F.aggregate(picks, F.struct(F.lit(0).alias("done"), none.alias("out")), lambda a, p: F.when(p["at"] < a["done"], a).otherwise(F.struct(
        (p["at"] + p["n"]).alias("done"),
        F.concat(a["out"], F.array(_segment(_joined(groups, a["done"], p["at"] - a["done"]), None), _segment(_joined(groups, p["at"], p["n"]), "card"))).alias("out"))),
        lambda a: F.concat(a["out"], F.array(_segment(_joined(groups, a["done"], F.size(groups) - a["done"]), None))))


def _pick(at: Column, n: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))


def _bound(value: Column, fn) -> Column:
    """fn(value), with the value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _grouped(run: Column) -> Column:
    """The cards of a run that are written in one of the usual ways."""
    def cut(groups):
        def pick(at):
            some = _joined(groups, at, F.lit(5))
            n = F.coalesce(*[F.when(some.rlike(f"^[ -]?{p}(?!\\d)") & _right(_joined(groups, at, F.lit(k))), F.lit(k)) for k, p in CARDS])
            return _pick(at, n)
        picks = F.transform(groups, lambda _, at: pick(at))
        return _cut(groups, F.filter(picks, lambda p: p["n"].isNotNull()))
    return _bound(F.split(run, "(?=[ -])"), cut)


def _ungrouped(run: Column) -> Column:
    """The card of a short run that is grouped in any other way: the whole run
    or else its longest head or tail with one kind of separator."""
    def cut(groups):
        size = F.size(groups)
        ends = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda n: F.array(_pick(F.lit(0), n), _pick(size - n, n))))
        told = F.transform(ends, lambda p: F.struct(p.alias("p"), F.regexp_replace(_joined(groups, p["at"], p["n"]), "^[ -]", "").alias("m")))
        fits = F.filter(told, lambda x: F.length(F.regexp_replace(x["m"], "[ -]", "")).between(13, 19)
                        & ((x["p"]["n"] == size) | x["m"].rlike(r"^\d+(?:([ -])\d+(?:\1\d+)*+)?$")) & _right(x["m"]))
        best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(F.regexp_replace(x["m"], "[ -]", "")).alias("digits"), (-x["p"]["at"]).alias("head"), x["p"].alias("p"))))
        return _cut(groups, F.filter(F.array(best["p"]), lambda p: p.isNotNull()))
    return _bound(F.split(run, "(?=[ -])"), cut)


def _cards(run: Column) -> Column:
    """array<struct<m, kind>> of a run of digits: the cards in it, with a right
    Luhn sum, and what stands between them."""
    short = lambda m: F.length(F.regexp_replace(m, "[ -]", "")).between(13, 19 + BESIDE)
    return F.flatten(F.transform(_grouped(run), lambda x: F.when(x["kind"].isNull() & short(x["m"]), _ungrouped(x["m"])).otherwise(F.array(x))))


def _matches(text: Column) -> Column:
    """array<array<struct<m, kind>>> of a text: the segments of each match."""
    told = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    return F.transform(told, lambda x: F.when(x["kind"] == "card", _cards(x["m"])).otherwise(F.array(x)))


def _units(m: Column, kind: Column) -> Column:
    """What a match refers to, in canonical form: one unit, or given names
    and surname.  Two spellings of one number or address have one unit."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.regexp_replace(m, r"^\S+ ", "")
    script = F.when(name.rlike(r"^\p{IsCyrillic}"), F.lit("cyr")).otherwise(F.lit("lat"))
    sex = F.when(m.rlike(FEMALE), F.lit("f")).otherwise(F.lit("m"))
    part = lambda role, value: _unit(F.concat_ws("_", F.lit(role), sex, script), F.lower(value))
    return (F.when(kind == "person", F.concat(F.transform(F.slice(F.split(name, " "), F.lit(1), F.size(F.split(name, " ")) - 1), lambda x: part("given", x)),
                                                  F.array(part("surname", F.substring_index(name, " ", -1)))))
            .when(kind.isin("phone", "ssn", "card"), F.array(_unit(kind, digits)))
            .when(kind == "email", F.array(_unit(kind, F.lower(m))))
            .when(kind == "secret", F.array(_unit(kind, F.regexp_replace(m, f"^{ASSIGNED}", ""))))
            .when(kind.isNotNull(), F.array(_unit(kind, m)))
            .otherwise(F.array().cast("array<struct<kind:string,canon:string>>")))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits from the key and the unit."""
    base = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(base, F.lit("|0")), 256), F.sha2(F.concat(base, F.lit("|1")), 256))


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i * 2) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _like(stream: Column, value: Column) -> Column:
    """Each letter or digit replaced by a keyed one of its class."""
    hexes = value.rlike("^[0-9a-f]+$")

    def one(c, i):
        n = _number(stream, i)
        return (F.when(hexes, F.substr(stream, (i % 128) + 1, F.lit(1)))
                .when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char((n % 26 + 97).cast("long")))
                .when(c.rlike("[A-Z]"), F.char((n % 26 + 65).cast("long")))
                .when(c.rlike(r"\p{L}"), F.char((n % 26 + 97).cast("long"))).otherwise(c))
    return F.array_join(F.transform(F.split(value, "(?<=.)(?=.)"), one), "")


def _name(stream: Column, kind: Column, attempt: Column) -> Column:
    """A name of keyed syllables in the script, with the ending of the gender;
    longer after failed attempts."""
    script = F.substring_index(kind, "_", -1)
    parts = F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 2).cast("int"))
    body = {s: F.array_join(F.transform(parts, lambda i: F.element_at(F.array(*map(F.lit, v)), _number(stream, i) % len(v) + 1)), "")  # noqa: B023
            for s, v in SYLLABLES.items()}
    end = F.element_at(F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv]), kind)
    return F.concat(F.when(script == "cyr", body["cyr"]).otherwise(body["lat"]), end)


def _surrogate(s: Column, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a unit, in canonical form, from its stream ``s``."""
    rest = F.substr(canon, F.lit(2))
    card = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(_like(s, F.concat(F.lit("-"), F.substr(canon, F.lit(2), F.length(canon) - 2))), F.lit(2)))
    check = (F.lit(10) - _luhn(F.concat(card, F.lit("0"))) % 10) % 10
    octets = [(_number(s, F.lit(i)) % 256).cast("string") for i in (1, 2, 3)]
    return (F.when(kind == "email", F.concat(_like(s, F.regexp_extract(canon, r"^(.*)\.[a-z]+$", 1)), F.regexp_extract(canon, r"\.[a-z]+$", 0)))
            .when(kind == "ip", F.concat_ws(".", (_number(s, F.lit(0)) % 15 + 240).cast("string"), *octets))
            .when(kind == "phone", F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(_like(s, F.concat(F.lit("-"), rest)), F.lit(2))))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(_like(s, F.concat(F.lit("-"), rest)), F.lit(2))))
            .when(kind == "card", F.concat(card, check.cast("string")))
            .when(kind == "key", F.concat(F.substr(canon, F.lit(1), F.lit(4)), _like(s, F.substr(canon, F.lit(5)))))
            .when(kind == "secret", _like(s, canon))
            .otherwise(_name(s, kind, attempt)))


def settle(units: DataFrame, key: str) -> DataFrame:
    """Attempts of distinct ``units(kind, canon)`` such that no two units of a
    kind share a surrogate and none is a real unit of the corpus.

    Units that clash try again with the next attempt; of several with one
    surrogate the one settled first, then the least, keeps it.
    """
    unit = F.col("kind"), F.col("canon"), F.col("attempt")
    now = stored(units.select("kind", "canon", F.lit(0).alias("attempt")).withColumn("s", _stream(key, *unit))
                 .withColumn("sur", _surrogate(F.col("s"), *unit)).drop("s"), "units")
    while True:
        keep = now.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        real = now.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
        judged = (now.join(keep.where("n > 1").select("kind", "sur", F.col("first.canon").alias("holder")), ["kind", "sur"], "left")
                  .join(real, ["kind", "sur"], "left")
                  .withColumn("clash", F.coalesce("real", F.lit(False)) | F.coalesce(F.col("holder") != F.col("canon"), F.lit(False))))
        judged = stored(judged.select("kind", "canon", "sur", "clash", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")), "judged")
        if judged.where("clash").isEmpty():
            return judged.select("kind", "canon", "attempt", "sur")
        now = judged.withColumn("s", _stream(key, *unit)).select(
            "kind", "canon", "attempt", F.when(F.col("clash"), _surrogate(F.col("s"), *unit)).otherwise(F.col("sur")).alias("sur"))


def _surrogates(key: str, units: Column, tries: Column) -> Column:
    """Surrogates of an array of units; each step is bound once."""
    def tried(u):
        known = F.filter(tries, lambda t: (t["kind"] == u["kind"]) & (t["canon"] == u["canon"]))
        return F.struct(u["kind"].alias("kind"), u["canon"].alias("canon"),
                        F.coalesce(F.try_element_at(known, F.lit(1))["attempt"], F.lit(0)).alias("attempt"))
    keyed = F.transform(F.transform(units, tried), lambda u: F.struct(
        u.alias("u"), _stream(key, u["kind"], u["canon"], u["attempt"]).alias("s")))
    return F.transform(keyed, lambda x: _surrogate(x["s"], x["u"]["kind"], x["u"]["canon"], x["u"]["attempt"]))


def _write(m: Column, kind: Column, surs: Column) -> Column:
    """A match with its units replaced, in the format of the match."""
    first = F.get(surs, F.lit(0))
    places = F.split(m, "(?<=.)(?=.)")
    # digits of the surrogate go where the match has digits
    digits = F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.struct(
        F.concat(a["out"], F.when(c.rlike("[0-9]"), F.substr(first, a["at"], F.lit(1))).otherwise(c)).alias("out"),
        (a["at"] + c.rlike("[0-9]").cast("int")).alias("at")))["out"]
    named = F.concat(F.regexp_extract(m, r"^\S+ ", 0), F.array_join(F.transform(surs, lambda s: F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2)))), " "))
    return (F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "person", named)
            .when(kind == "secret", F.concat(F.regexp_extract(m, f"^{ASSIGNED}", 0), first))
            .when((kind == "email") & (m == F.upper(m)), F.upper(first))
            .when(kind.isNotNull(), first).otherwise(m))


def replace_private(docs: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """Replace personal data and secrets in ``docs.text`` by surrogates.

    Detected: passwords and tokens in assignments, e-mail addresses, access
    keys, IPv4 addresses, phone numbers, social security numbers, payment card
    numbers with a right Luhn sum, also beside other digits (`_cards`), and
    names after a title.  A surrogate is
    keyed (``key``) and has the type and format of what it stands for: digits
    for digits, letters for letters, a right check digit, a name of the same
    gender and script.  The same unit has the same surrogate everywhere, two
    units never the same one, and no surrogate is a real unit of the corpus
    (`settle`).

    All columns and rows of ``docs`` stay, only ``text`` changes; texts
    without a match and null or empty texts stay as they are.  Equal texts
    change alike, repeated rows and null ids are ordinary rows, and an empty
    table gives an empty result.  Texts do not move unless some unit needed a
    second attempt in more texts than a broadcast holds.
    """
    text = F.col("text")
    hit = text.rlike(ANY)
    seen = (docs.select("text").where(hit).select(F.sha2(text, 256).alias("_th"), F.explode(F.flatten(F.transform(
        F.flatten(_matches(text)), lambda x: _units(x["m"], x["kind"])))).alias("u")).select("_th", "u.kind", "u.canon"))
    seen = stored(seen.distinct(), "private")
    again = settle(seen.select("kind", "canon").distinct(), key).where("attempt > 0")
    tries = stored(seen.join(again, ["kind", "canon"]).groupBy("_th").agg(
        F.collect_list(F.struct("kind", "canon", "attempt")).alias("_tries")), "tries")
    none = F.array().cast("array<struct<kind:string,canon:string,attempt:int>>")
    marked = docs.withColumn("_th", F.when(hit, F.sha2(text, 256))).join(tries, "_th", "left")
    tries = F.coalesce("_tries", none)

    def rewritten(segments):
        read = F.transform(segments, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _units(x["m"], x["kind"]).alias("units")))
        drawn = F.transform(read, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _surrogates(key, x["units"], tries).alias("surs")))
        return F.array_join(F.transform(drawn, lambda x: _write(x["m"], x["kind"], x["surs"])), "")
    written = F.transform(_matches(text), rewritten)
    pieces = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, written, lambda p, w: F.array(p, F.coalesce(w, F.lit(""))))), "")
    return marked.withColumn("text", F.when(F.col("_th").isNull(), text).otherwise(whole)).select(*docs.columns)
