"""Personal data by candidate gradient boosting (DataFrame functions only).

Generators with high recall propose overlapping spans. Four of them (email, ip, card, phone) are exact patterns
with a check and their spans always stay. The others propose obfuscated emails, national phone numbers, secrets,
account and identity numbers; boosted trees judge each from its format and the text around it, and a calibrated
threshold per kind selects it. A selected span that overlaps a base span, or a better selected one, is dropped.
The trees are fitted on ``SYNTHETIC`` generated, labelled snippets per kind (a fixed number, whatever the input)
and run as one nested CASE expression. A row is never split or moved, so there is no shuffle.

Positions count code points, from 0, end exclusive. Defined results: null text counts as empty and keeps null
when redacted; repeated rows give repeated results; null doc_ids pass; whole texts of any length are searched;
columns other than doc_id and text are ignored by ``detect`` and kept by ``redact``; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import boost

BASE = ("email", "ip", "card", "phone")
#: Patterns equal to the contract's, written so that no engine retries inside a run of characters.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text for its pattern to be tried.
CHEAP = {"email": "@", "phone": "+"}
EXTRA = ("masked_email", "national_phone", "secret", "iban", "national_id")
EXTRA_PATTERNS = {
    "masked_email": r"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*(?:_at_|-at-)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*?(?:(?:_dot_|-dot-|\.)[A-Za-z0-9]+)+|"
    r"(?!(?:me|us|him|her|it|them|e?mail|contact|reach|write)\x20at\x20)[A-Za-z0-9._%+-]++(?: ?[\[({<] ?at ?[\])}>] ?|\x20at\x20|\x20-at-\x20|\x20@\x20)[A-Za-z0-9-]++(?:(?: ?[\[({<] ?dot ?[\])}>] ?|\x20dot\x20|\x20-dot-\x20|\x20\.\x20|\.)[A-Za-z0-9-]++)++)",
    "national_phone": r"(?<![0-9+A-Za-z])(?<![0-9][\x20.,/-])(?:\([0-9]{2,5}\)[\x20./-]?)?[0-9]{1,12}(?:[\x20./-][0-9]{2,7}){0,5}(?![0-9A-Za-z])(?![.,/-][0-9])",
    "secret": r"(?<![A-Za-z0-9_/+!@#$%^&*~-])[A-Za-z0-9_/+!@#$%^&*~-]{6,}+={0,2}",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30}|[a-z]{2}[0-9]{2}(?:[\x20-][a-z]{4})?(?:[\x20-][0-9]{4}){2,6}(?:[\x20-][0-9]{1,3})?)(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}|[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D]|[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}(?:\x20?[0-9]{2})?|"
    r"[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z]|[0-9]{2}\x20[0-9]{3}\x20[0-9]{3}\x20[0-9]{3})(?![0-9A-Za-z-])",
}
FEATURES = ("length", "digits", "upper", "lower", "others", "distinct", "secret_word", "phone_word", "account_word", "mail_word", "assigned", "check", "before", "after", "known", "domain", "groups", "zero", "date")
CONTEXT = 32
SYNTHETIC, SEED, WANTED = 800, 5, 0.97
BLOCK = 256
#: Characters of a text's blocks when spans are replaced; a position beyond all.
SLICE, FAR = 4096, 1 << 60
SECRET_WORD = r"(?i)(?:pass(?:word|wd|wort|phrase|code)?|kennwort|mot de passe|contrase[ñn]a|clave|pwd|token|secret|(?:api|access|private)[_ -]?key|key|auth|bearer|credentials?)[\"']?\s{0,2}(?:[:=]|is)?\s{0,2}[\"']?$"
ASSIGNED = r"(?i)(?:[:=]|(?<![a-z])bearer)\s{0,2}[\"']?$"
#: Beginnings of keys that services hand out.
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|xox[abprs]-|eyJ|AIza)"
DOMAIN = r"(?i)(?:\.| \. |[ _-]dot[ _-]| -dot- |[\[({<] ?dot ?[\])}>] ?)(?:com|org|net|edu|gov|info|io|co|eu|uk|us|de|fr|es|it|nl|ch|at|be|pl|ru|jp|cn|in|br|ca|au)$"
PHONE_WORD = r"(?i)(?:t[eé]l|phone|call|fax|mobil|cell|dial|contact|handy|portable|m[oó]vil|whatsapp|hotline|ph)[.a-zéó]{0,8}\s{0,2}[:#]?\s{0,2}(?:at |on |me |us ){0,2}$"
ACCOUNT_WORD = r"(?i)(?:iban|account|acct|konto|compte|cuenta|ssn|social security|tax id|national id|national insurance|nino|dni|nie|nir|insee|steuer-?id|identity|passport)(?: number| card| no\.?)?\s{0,2}[:#]?\s{0,2}(?:is )?$"
#: A day of a calendar, in the usual orders.
DATE = r"^(?:(?:19|20)[0-9]{2}([./ -])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([./ -])[0-3]?[0-9]\2(?:19|20)?[0-9]{2})$"
MAIL_WORD = r"(?i)(?:e-?mail|write|mail|contact|reach)(?: me| us| to| at){0,3}\s{0,2}:?\s{0,2}$"


def running(values: Column, step: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Inclusive running results of ``step`` over an array of ints, in blocks so that the work stays near linear for long arrays."""

    def plain(part: Column, start: Column) -> Column:
        first = F.struct(F.array().cast("array<bigint>").alias("out"), start.cast("long").alias("at"))
        return F.aggregate(part, first, lambda acc, v: F.struct(F.concat(acc["out"], F.array(step(acc["at"], v.cast("long")))).alias("out"), step(acc["at"], v.cast("long")).alias("at")))["out"]

    def blocked(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        done = plain(F.transform(parts, lambda p: F.aggregate(p, F.lit(zero).cast("long"), lambda a, x: step(a, x.cast("long")))), F.lit(zero))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), _shifted(done, zero).alias("s")), lambda z: F.when(z["p"].isNull(), F.array().cast("array<bigint>")).otherwise(plain(z["p"], z["s"]))))

    return F.when(F.size(values) <= BLOCK, plain(values, F.lit(zero))).otherwise(blocked(values))


def _shifted(values: Column, zero: int) -> Column:
    """What was there before each element: ``zero``, then all but the last."""
    return F.concat(F.array(F.lit(zero).cast("long")), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


def _found(df: DataFrame, name: str, pattern: str, guard: Column | None) -> DataFrame:
    """Adds column ``name``: array of (start, x, left, right): each match with the text around it."""
    m, p = f"__m_{name}", f"__p_{name}"
    none = F.array().cast("array<string>")
    matches = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
    df = df.withColumn(m, F.when(guard, matches).otherwise(none) if guard is not None else matches)
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("__text", pattern, -1)).otherwise(none))
    # Arrays enter lambdas only as arguments: a column named inside one could be computed anew for each element.
    k = F.size(m)
    df = df.withColumn(f"__l_{name}", F.slice(p, F.lit(1), k)).withColumn(f"__r_{name}", F.slice(p, F.lit(2), k))
    before = F.when(k > 0, F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), k - 1))).otherwise(none)
    df = df.withColumn(f"__b_{name}", F.transform(before, lambda x: F.substring(x, -CONTEXT, CONTEXT)))  # the text to the left begins with the match before
    df = df.withColumn(f"__d_{name}", F.zip_with(f"__l_{name}", before, lambda left, x: F.length(left) + F.length(x)))
    df = df.withColumn(f"__s_{name}", F.when(k > 0, running_sum(F.col(f"__d_{name}"))).otherwise(F.array().cast("array<bigint>")))
    zipped = F.arrays_zip(F.col(f"__s_{name}").alias("s"), F.col(m).alias("m"), F.col(f"__l_{name}").alias("l"), F.col(f"__r_{name}").alias("r"), F.col(f"__b_{name}").alias("b"))
    around = F.transform(
        zipped,
        lambda z: F.struct(z["s"].alias("start"), z["m"].alias("x"), F.substring(F.concat(z["b"], z["l"]), -CONTEXT, CONTEXT).alias("left"), F.substring(z["r"], 1, 1).alias("right")),
    )
    return df.withColumn(name, around).drop(m, p, *[f"__{c}_{name}" for c in "lrdsb"])


def _valid(kind: str, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        part = lambda v: F.length(F.ltrim(v, F.lit("0"))) <= 3
        return F.forall(F.split(x, r"\."), lambda v: part(v) & (F.coalesce(F.when(part(v), v.cast("int")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _mod97(x: Column) -> Column:
    """Whether an account number passes the remainder check of its format."""
    bare = F.upper(F.regexp_replace(x, "[ -]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.ascii(c) - 55
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + value(c)) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def features(kind: str, c: Column) -> list[Column]:
    """Numbers that describe a candidate (start, x, left, right), in the order of ``FEATURES``."""
    x, left = c["x"], c["left"]
    count = lambda p: F.length(F.regexp_replace(x, p, "")).cast("double")
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    return [
        F.length(x).cast("double"), count("[^0-9]"), count("[^A-Z]"), count("[^a-z]"), count("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(x, ""))).cast("double"),
        flag(left.rlike(SECRET_WORD)), flag(left.rlike(PHONE_WORD)), flag(left.rlike(ACCOUNT_WORD)), flag(left.rlike(MAIL_WORD)), flag(left.rlike(ASSIGNED)),
        flag(_mod97(x)) if kind == "iban" else F.lit(0.0),
        flag(left.rlike(r"[\p{L}\p{N}]$")), flag(c["right"].rlike(r"^[\p{L}\p{N}]")),
        flag(x.rlike(KNOWN)), flag(x.rlike(DOMAIN)),
        *([F.size(F.split(x, "[^0-9]+")).cast("double"), flag(x.rlike(r"^\(?0")), flag(x.rlike(DATE))] if kind in ("national_phone", "national_id") else [F.lit(0.0)] * 3),
    ]


def synthetic(kind: str, n: int = SYNTHETIC, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled snippets, half with personal data of the kind and half with look-alikes, made from ``seed``."""
    r = random.Random(f"{seed}{kind}")
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    any_ = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))

    def iban(right: bool) -> str:
        body, land = digits(18), r.choice(["DE", "FR", "ES", "GB", "NL"])
        number = int(body + "".join(str(ord(c) - 55) for c in land) + "00")
        check = 98 - number % 97
        raw = f"{land}{check if right else (check + 7) % 97:02d}{body}"
        raw = raw.lower() if r.random() < 0.3 else raw
        return r.choice([" ", " ", "-"]).join(raw[i : i + 4] for i in range(0, len(raw), 4)) if r.random() < 0.5 else raw

    def phone() -> str:
        """A number in the shape of one of several countries; those with a leading zero are plain without a word before them."""
        a, z = digits(3), "0" + r.choice("123456789")
        gap = r.choice(" .-")
        return r.choice([
            lambda: f"({a}) {digits(3)}-{digits(4)}", lambda: f"{a}-{digits(3)}-{digits(4)}", lambda: f"{a}.{digits(3)}.{digits(4)}", lambda: f"1-800-{digits(3)}-{digits(4)}", lambda: gap.join([z, digits(2), digits(2), digits(2), digits(2)]),
            lambda: f"{z}{digits(1)} {digits(4)} {digits(4)}", lambda: f"{z}{digits(3)} {digits(6)}", lambda: f"{z}{digits(1)}{r.choice(' /-')}{digits(r.randint(6, 8))}", lambda: f"({z}{digits(1)}) {digits(7)}",
            lambda: f"6{digits(2)} {digits(3)} {digits(3)}", lambda: digits(r.randint(7, 11)), lambda: f"{digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}",
        ])()

    def identity() -> str:
        return r.choice([
            lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{digits(3)} {digits(2)} {digits(4)}", lambda: f"{r.choice('ABCEGH')}{r.choice('ABCEGH')} {digits(2)} {digits(2)} {digits(2)} {r.choice('ABCD')}", lambda: f"{r.choice('ABCEGH')}{r.choice('ABCEGH')}{digits(6)}{r.choice('ABCD')}",
            lambda: f"{r.choice('12')} {digits(2)} {digits(2)} {digits(2)} {digits(3)} {digits(3)} {digits(2)}", lambda: f"{digits(8)}{r.choice('ABCDEFGHJKLMNPQRSTVWXYZ')}", lambda: f"{r.choice('XYZ')}-{digits(7)}-{r.choice('ABCDEFGH')}", lambda: f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}",
        ])()

    def positive() -> str:
        if kind == "masked_email":
            dot = r.choice([" [dot] ", "(dot)", " (dot) ", ".", " {dot} "])
            local = r.choice([word, lambda: f"{word()}.{word()}{digits(2)}", lambda: "".join(word() for _ in range(12))])()
            if r.random() < 0.25:
                return r.choice(["mail me at ", "write to ", "email: ", "contact: "]) + f"{local} at {word()} dot {r.choice(['com', 'org', 'net', 'de', 'fr'])}" + r.choice([" ", ".", ","])
            if r.random() < 0.3:
                user, site, end = word(), word(), r.choice(["com", "org", "net", "de", "co", "fr"])
                return r.choice([word() + " ", "mail me at ", "contact: "]) + r.choice([f"{user}_at_{site}_dot_{end}", f"{user}-at-{site}-dot-{end}", f"{user} -at- {site} -dot- {end}", f"{user} @ {site} . {end}", f"{user} @ {site}.{end}", f"{user} -at- {site}.{end}"]) + " "
            return r.choice([word() + " ", "mail me at ", "contact: "]) + f"{local}{r.choice([' [at] ', '(at)', ' (at) ', ' {at} ', '[AT]', ' <at> '])}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'co', 'fr'])} "
        if kind == "national_phone":
            number = phone()
            bare = number.lstrip("(").startswith("0") and sum(c.isdigit() for c in number) >= 9 and not number.isdigit() and r.random() < 0.5
            return (word() + " " if bare else r.choice(["Tel: ", "Tel. ", "phone ", "call me at ", "Fax: ", "mobile: ", "contact ", "tel ", "Telefon: ", "Handy ", "mobil: ", "WhatsApp: "])) + number + r.choice([" ", ".", ", "])
        if kind == "secret":
            if r.random() < 0.1:
                return r.choice([word() + " ", "key ", "", "use "]) + r.choice(["AKIA" + any_(16).upper(), "ghp_" + any_(36), "sk-" + any_(40), "xoxb-" + digits(11) + "-" + any_(24)]) + r.choice([" ", "\n", ","])
            letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(8, 80)))
            body = r.choice([lambda: hexa(r.randint(14, 64)), lambda: any_(r.randint(8, 64)), lambda: "a1" + hexa(r.randint(14, 48)), letters, lambda: word() + digits(2) + r.choice("!#$%") + word(), lambda: word() + word() + word()])()
            name = r.choice(["password", "passwort", "Kennwort", "mot de passe", "clave", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "API-KEY", "access_key", "auth_token", "client_secret", "credential"])
            lead = r.choice([f"{name}=", f'{name} = "', f"{name}: ", f'{name}: "', f'"{name}": "', f"{name}='", "Authorization: Bearer "])
            return lead + (body if len(body) >= 6 else body + "x1y2z3") + r.choice(['"', " ", "\n", "'"])
        if kind == "iban":
            return r.choice([word() + " ", "IBAN: ", "account "]) + iban(True) + r.choice([" ", "."])
        return r.choice(["SSN: ", "social security number ", "ssn ", "tax id: ", "NINO: ", "DNI: ", "NIR ", "Steuer-ID: ", "national insurance number ", "identity card ", "passport no. "]) + identity() + r.choice([" ", ","])

    def negative() -> str:
        lead = r.choice([word() + " ", word() + ", ", "see ", "id ", "", "page: ", "build "])
        if kind == "masked_email":
            return r.choice([
                lambda: f"{lead}{word()} (at) {word()} {word()}", lambda: f"{lead}{word()} (at) {word()}.{digits(r.randint(1, 3))} {word()}", lambda: f"{lead}{word()} at {word()}.{word()} {word()}",
                lambda: f"{lead}{word()} at {digits(1)}.{digits(2)} {word()}", lambda: f"{lead}{word()} at {word()} dot {word()} {word()}",
                lambda: f"{lead}{word()} at {word()}.{r.choice(['com', 'org', 'net', 'de'])} {word()}",
                lambda: f"{lead}{word()}-at-{word()}.{word()} {word()}", lambda: f"{lead}{word()}_at_{word()}.{r.choice(['txt', 'py', 'xyzzy'])} {word()}", lambda: f"{lead}{word()} @ {word()}.{digits(2)} {word()}", lambda: f"{lead}{word()} @ {word()} . {word()}word",
            ])()
        if kind == "national_phone":
            year, month, day = f"{r.choice(['19', '20'])}{digits(2)}", f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
            return lead + r.choice([
                f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{day} {month} {year}", f"{r.randint(1, 9)} {digits(3)} {digits(3)}",
                digits(r.randint(6, 12)), f"{digits(3)}-{digits(4)}", f"00{digits(3)}-{digits(3)}", f"{digits(4)}-{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}",
            ]) + " " + word()
        if kind == "secret" and r.random() < 0.4:
            long = word() + word() + "tion"
            return r.choice([f"name = \"{long}\" ", f"color: {long} ", f"path={long}/{word()}/{word()}3 ", f"the secret {long} ", f"key {long} ", f"a token {long} ", f"pass {long} ", f"version={digits(2)}-{hexa(12)} ", f"{long}: {long}2024 ", f"id={hexa(24)} "])
        if kind == "secret":
            return lead + r.choice([digits(r.randint(12, 20)), hexa(32), hexa(40), any_(20), word() + word() + "-" + word() + digits(2), "2024-01-0" + digits(6), "/".join([word(), word(), digits(4), word()])]) + r.choice([" ", ".", "/"])
        if kind == "iban":
            return lead + iban(False) + " "
        return lead + identity() + " " + word()

    return [(positive(), 1) if i % 2 else (negative(), 0) for i in range(n)]


_models: dict = {}


def models(spark) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each extra kind: fitted on half of the snippets, calibrated on the other half."""
    if not _models:
        for kind in EXTRA:
            rows = [(i, t, y) for i, (t, y) in enumerate(synthetic(kind))]
            df = spark.createDataFrame(rows, "i int, text string, y int").withColumn("__text", F.col("text"))
            df = _likely(_found(df, "c", EXTRA_PATTERNS[kind], None), "c", kind).select("i", "y", F.explode("c").alias("c"))
            got = df.select("i", "y", F.array(*features(kind, F.col("c"))).alias("f")).collect()  # at most a few for each snippet
            x, y, i = np.array([r.f for r in got]), np.array([r.y for r in got], float), np.array([r.i for r in got])
            own = (i // 2) % 2 == 0
            trees = boost.fit(x[own], y[own])
            _models[kind] = (trees, boost.calibrate(boost.margin(trees, x[~own]), y[~own], WANTED))
    return dict(_models)


def _likely(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Candidates worth features: a phone has 6 to 12 digits; a run that may be a secret has a digit and some length, or stands where one is given, or begins like a key."""
    if kind == "national_phone":
        return df.withColumn(name, F.filter(name, lambda c: F.length(F.regexp_replace(c["x"], "[^0-9]", "")).between(6, 12)))
    if kind != "secret":
        return df
    return df.withColumn(name, F.filter(name, lambda c: (c["x"].rlike("[0-9]") & (F.length(c["x"]) >= 12)) | c["left"].rlike(SECRET_WORD) | c["x"].rlike(KNOWN)))


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def spans(df: DataFrame) -> DataFrame:
    """Adds ``__base`` and ``__extra``: arrays of (kind, s, e[, margin]) in order of kind, then start."""
    fitted = models(df.sparkSession)
    low = F.lower("__text")
    guards = {"masked_email": low.rlike(r"[\[({<] ?at ?[\])}>]| at |_at_|-at-| @ ") & low.rlike(r"\.|dot"), "secret": F.col("__text").rlike(r"[0-9]|(?i:pass|pwd|token|secret|key|auth|bearer|credential|kennwort|clave|contrase)")}
    out = df.withColumn("__text", F.coalesce("text", F.lit("")))
    digit = F.col("__text").rlike("[0-9]")
    for kind in BASE:
        guard = F.col("__text").contains(CHEAP[kind]) if kind in CHEAP else digit
        out = _found(out, f"__{kind}", BASE_PATTERNS[kind], guard)
    for kind in EXTRA:
        out = _likely(_found(out, f"__{kind}", EXTRA_PATTERNS[kind], guards.get(kind, digit)), f"__{kind}", kind)

    def base(kind: str) -> Column:
        good = F.filter(F.col(f"__{kind}"), lambda c: _valid(kind, c["x"]))
        return F.transform(good, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("s"), (c["start"] + F.length(c["x"])).alias("e")))

    def described(kind: str) -> Column:
        return F.transform(
            F.col(f"__{kind}"),
            lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("s"), (c["start"] + F.length(c["x"])).alias("e"), F.array(*features(kind, c)).alias("f")),
        )

    for kind in EXTRA:
        out = out.withColumn(f"__{kind}", described(kind))

    def judged(kind: str) -> Column:
        trees, least = fitted[kind]
        return F.expr(f"filter(transform(__{kind}, c -> struct(c.kind AS kind, c.s AS s, c.e AS e, {boost.expression(trees, 'c.f')} AS margin)), c -> c.margin >= {least!r}D)")

    out = out.withColumn("__base", F.concat(*[base(k) for k in BASE])).withColumn("__judged", F.concat(*[judged(k) for k in EXTRA]))
    # Base spans and candidates in one order of starts, base first: a candidate touches an earlier base span if one ends beyond its start, a later one if one starts before its end.
    both = F.concat(F.transform("__base", lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("j"), b["e"].alias("e"), F.lit(0.0).alias("margin"), b["kind"].alias("kind"))), F.transform("__judged", lambda c: F.struct(c["s"].alias("s"), F.lit(1).alias("j"), c["e"].alias("e"), c["margin"].cast("double").alias("margin"), c["kind"].alias("kind"))))
    some = F.size("__judged") > 0
    none = F.array().cast("array<struct<s:bigint,j:int,e:bigint,margin:double,kind:string>>")
    out = out.withColumn("__order", F.when(some, F.array_sort(both)).otherwise(none))
    out = out.withColumn("__until", running(F.transform("__order", lambda c: F.when(c["j"] == 0, c["e"]).otherwise(0)), F.greatest))
    out = out.withColumn("__next", F.reverse(running(F.reverse(F.transform("__order", lambda c: F.when(c["j"] == 0, c["s"]).otherwise(FAR))), F.least, FAR)))
    zipped = F.arrays_zip(F.col("__order").alias("c"), F.col("__until").alias("u"), F.col("__next").alias("n"))
    out = out.withColumn("__free", F.transform(F.filter(zipped, lambda z: (z["c"]["j"] == 1) & (z["u"] <= z["c"]["s"]) & (z["n"] >= z["c"]["e"])), lambda z: z["c"]))
    # The same among candidates; only those that touch others are compared with each other.
    out = out.withColumn("__until", _shifted(running(F.transform("__free", lambda c: c["e"]), F.greatest), 0))
    follow = F.concat(F.slice(F.transform("__free", lambda c: c["s"]), F.lit(2), F.greatest(F.size("__free"), F.lit(1))), F.array(F.lit(FAR).cast("long")))
    zipped = F.arrays_zip(F.col("__free").alias("c"), F.col("__until").alias("u"), follow.alias("n"))
    touches = lambda z: (z["u"] > z["c"]["s"]) | (z["n"] < z["c"]["e"])
    marked = F.filter(zipped, lambda z: z["c"].isNotNull())
    out = out.withColumn("__alone", F.transform(F.filter(marked, lambda z: ~touches(z)), lambda z: z["c"])).withColumn("__touching", F.transform(F.filter(marked, touches), lambda z: z["c"]))
    better = lambda c, d: (d["margin"] > c["margin"]) | ((d["margin"] == c["margin"]) & ((d["s"] < c["s"]) | ((d["s"] == c["s"]) & (d["e"] > c["e"]))))
    best = F.filter("__touching", lambda c: ~F.exists(F.col("__touching"), lambda d: _overlap(d, c) & better(c, d)))
    shown = lambda a: F.transform(a, lambda c: F.struct(F.array_position(F.lit(list(EXTRA)), c["kind"]).alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
    extra = F.transform(F.array_sort(F.concat(shown(F.col("__alone")), shown(best))), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    out = out.withColumn("__extra", F.when(some, extra).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")))
    return out.drop("__judged", "__order", "__until", "__next", "__free", "__alone", "__touching", *[f"__{k}" for k in (*BASE, *EXTRA)])


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of every row: the contract's columns, then n_extra."""
    found = spans(docs.select("doc_id", "text"))
    number = lambda k: F.size(F.filter("__base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [number(k) for k in BASE]
    base = _joined(F.col("__base"))
    extra = F.when(F.size("__extra") > 0, _joined(F.col("__extra")))
    return found.select(
        "doc_id", *n, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(F.size("__base") > 0, base), extra).alias("spans"), F.size("__extra").cast("long").alias("n_extra")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span (overlapping ones joined) replaced by its kind in angle brackets; n_chars follows."""
    found = spans(docs)
    bare = lambda a: F.transform(a, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
    done = found.withColumn("__spans", F.array_sort(F.concat(bare(F.col("__base")), bare(F.col("__extra")))))
    done = done.withColumn("__until", running(F.transform("__spans", lambda c: c["e"]), F.greatest)).withColumn("__from", _shifted(F.col("__until"), 0))
    hit = F.size("__spans") > 0
    done = done.withColumn("__blocks", F.when(hit, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the blocks that hold them."""
        i, j = F.floor(a / SLICE).cast("int"), F.floor((b - 1) / SLICE).cast("int")
        at = (a - i * SLICE + 1).cast("int")
        whole = F.concat(F.substring(F.get(blocks, i), at, F.lit(SLICE)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), (b - j * SLICE).cast("int")))
        return F.when(b <= a, F.lit("")).when(i == j, F.substring(F.get(blocks, i), at, (b - a).cast("int"))).otherwise(whole)

    zipped = F.arrays_zip(F.col("__spans").alias("c"), F.col("__from").alias("f"))
    first = F.filter(zipped, lambda z: z["c"].isNotNull() & (z["c"]["s"] >= z["f"]))
    put = F.transform(first, lambda z: F.concat(piece(F.col("__blocks"), z["f"], z["c"]["s"]), F.lit("<"), F.upper(z["c"]["kind"]), F.lit(">")))
    tail = piece(F.col("__blocks"), F.element_at("__until", -1), F.length("__text").cast("long"))
    done = done.withColumn("text", F.when(hit, F.concat(F.array_join(put, ""), F.when(hit, tail))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
