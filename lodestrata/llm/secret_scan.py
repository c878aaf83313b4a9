"""Secret scanning by DataFrame functions alone: candidates by pattern, false positives removed by a random forest.

Candidates are the values of assignments to secret-like names, and maximal runs
of 12 and more token characters with a digit. A candidate's features are its
length, its character classes and the changes between them, how much of it
common word pieces cover, path marks, and the words beside it. The forest is
fitted by MLlib on labelled findings (a small built-in table unless one is
given) and then written out as one expression of CASE trees, so documents are
scored row by row, in the scan, with no shuffle and nothing collected.

Defined results: a null or empty text has no findings. Offsets are code points,
ends exclusive. Repeated rows each give their own findings; a key may be null.
Further columns, whatever their names, pass through `redacted` unchanged.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that secrets are assigned to, those of them that name a password, words that mark other kinds of numbers.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
PASSWORDS = "password|passwd|passphrase|pwd"
OTHERS = "commit|sha1|sha256|md5|etag|checksum|uuid|guid|isbn|issn|order|invoice|card|version|revision|phone|call|ref|id|build|page|img|file|photo|date|tracking|serial|model"
# Everyday words of three letters and more, in four languages, and words of file names, addresses and code. What they cover of a candidate is its dictionary coverage.
DICTIONARY = """the and for that with this have from they will would there what about which when make can like time just know take people into year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any give day most was were been are had not but you all one out who get has his her she him its may such being both each few more same than too very between under where why while
able ation ing ment ness less ful ship hood ence ance ible ical ious ward wise tion sion
les des est une pour dans que qui sur avec par plus nous vous mais tout bien aussi leur cette entre sans temps jour eau elle
der die das und ist nicht ein eine mit für auf dem den von wird auch nach zeit haus lich keit heit ung schaft isch
los las una para con del como más pero todo también esta cuando donde ción mente dad ado
file image photo picture version report draft final index page user data test build release article title content admin login home main site news blog post list item name type value table color style script module function class config setting server client service public private local global default object string number error message request response document download upload update backup archive letter music video audio
password secret change welcome master dragon monkey summer winter spring autumn sunshine football correct horse battery staple hunter shadow open let love god king queen star world hello blue green black white red""".split()
PIECES = "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))

_RUN = r"A-Za-z0-9+/_~\-"
_ASSIGN = rf"(?i:{NAMES})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
CANDIDATE = rf"{_ASSIGN}[^\s\"'|]{{6,}}|(?<![{_RUN}])(?=[A-Za-z+/_~\-]*[0-9])[{_RUN}]{{12,}}={{0,2}}"
#: Characters of the surroundings that neighbouring words are taken from.
SIDE = 60
CUTOFF = 0.5

FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "changes", "distinct", "hex", "numeric", "covered", "slashes", "underscores", "dashes", "assigned", "named", "other_kind", "in_path", "at_sign", "quoted", "known", "groups", "password")


def _count(value: Column, pattern: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))


def _features(x: Column) -> Column:
    """The features of one candidate: value v, prefix p, text before and after."""
    v, n = x["v"], F.greatest(F.length(x["v"]), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    left, right = F.lower(x["before"]), F.lower(x["after"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    known = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-|^eyJ[A-Za-z0-9_-]{10,}|^AIza[A-Za-z0-9_-]{30,}$|^glpat-"
    made = {
        "length": n,
        "digits": _count(v, "[0-9]") / n,
        "uppers": _count(v, "[A-Z]") / n,
        "lowers": _count(v, "[a-z]") / n,
        "symbols": _count(v, "[^A-Za-z0-9]") / n,
        "changes": changes / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(v.rlike(r"^[0-9_~+/\-]+$")),
        "covered": _count(F.lower(v), PIECES) / n,
        "slashes": _count(v, "/") / n,
        "underscores": _count(v, "_") / n,
        "dashes": _count(v, "-") / n,
        "assigned": flag(F.length(x["p"]) > 0),
        "named": flag(left.rlike(rf"\b({NAMES})\b\W*(is|was)?\W*$")),
        "other_kind": flag(left.rlike(rf"\b({OTHERS})\b\W{{0,4}}$")),
        "in_path": flag(left.rlike(r"(://[^\s]*|[/\\.@])$") | right.rlike(r"^(\.[a-z]{2,4}\b|[/\\])")),
        "at_sign": flag(right.rlike("^[.a-z0-9-]*@") | left.rlike("@$")),
        "quoted": flag(left.rlike("[\"']$") | x["p"].rlike("[\"']$")),
        "known": flag(v.rlike(known)),
        "password": flag(F.lower(x["p"]).rlike(PASSWORDS)),
        "groups": flag(v.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
    }
    return F.struct(*[made[k].cast("double").alias(k) for k in FEATURES])


def _candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _described(found: Column, gaps: Column) -> Column:
    """Each candidate with its value, its assignment, both sides, features and lengths."""

    def one(m, i):
        p = F.regexp_extract(m, f"^{_ASSIGN}", 0)
        v = F.regexp_extract(F.substring(m, F.length(p) + 1, F.length(m)), r"^(.*[A-Za-z0-9=])?", 0)
        return F.struct(p.alias("p"), v.alias("v"), m.alias("m"), F.right(F.get(gaps, i), F.lit(SIDE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(SIDE)).alias("after"), F.length(F.get(gaps, i)).alias("gap"))

    return F.transform(found, one)


def _trees(text: str) -> list:
    """The trees of an MLlib forest's description: nested (feature, threshold, yes, no) and votes."""
    lines = [x.strip() for x in text.splitlines()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # the Else line
        return int(feature), float(threshold), yes, node()

    out = []
    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            out.append(node())
        else:
            at += 1
    return out


def _vote(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, yes, no = tree
    return F.when(x[FEATURES[feature]] <= threshold, _vote(yes, x)).otherwise(_vote(no, x))


class Forest:
    """A fitted forest as an expression over a features struct: the share of trees that vote for a secret."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, x: Column) -> Column:
        votes = [_vote(t, x) for t in self.trees]
        return sum(votes[1:], votes[0]) / float(len(votes))


def labelled_findings(spark: SparkSession, rows: int = 1600, seed: int = 11) -> DataFrame:
    """(text, value, is_secret): written forms of secrets and of what only looks like them, from templates."""
    r = random.Random(seed)
    some = lambda n, chars: "".join(r.choice(chars) for _ in range(n))
    hexes, digits, upper, base = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: r.choice(DICTIONARY)
    name = lambda: "".join(word() for _ in range(r.randint(1, 3)))
    h = lambda n: some(n, hexes) if r.random() < 0.7 else some(n, hexes).upper()
    mark = lambda: r.choice(("", "", "", ".", ",", "!", ";", "!!", "...", "***", ")"))
    strong = base + "!?#$%&*+/"
    secret = [
        lambda: ("token = \"%s\"", h(40)), lambda: ("password=%s", h(18)), lambda: ("%s", "AKIA" + some(16, upper + "234567")), lambda: ("%s", "ghp_" + some(36, base)), lambda: ("api_key: %s", some(32, base)), lambda: ("API_KEY=%s", h(32)),
        lambda: ("secret = '%s'", some(40, base + "+/")), lambda: ("%s", "sk_live_" + some(24, base)), lambda: ("PASSWORD=%s", some(r.randint(9, 16), strong)), lambda: ("token %s", h(40)), lambda: ("auth: %s", "eyJ" + some(40, base)), lambda: ("Bearer %s", "eyJ" + some(40, base)),
        lambda: ("%s", some(40, base + "+/")), lambda: ("passwd: %s", name() + some(3, digits)), lambda: ("password = %s", name() + some(1, digits) + name()), lambda: ("password: %s", word() + word()), lambda: ("pwd=%s", word() + some(r.randint(1, 4), digits) + r.choice("!?#$") + some(2, base)), lambda: ("passphrase: %s", "-".join(word() for _ in range(3))),
        lambda: ("secret: %s", "".join(word() for _ in range(5))), lambda: ("secret key %s", h(32)), lambda: ("access_key=%s", some(40, base + "+/")), lambda: ("secret='%s'", some(r.randint(10, 16), strong)),
    ]
    clean = [
        lambda: ("%s", some(16, digits)), lambda: ("%s", some(r.randint(12, 19), digits)), lambda: ("commit %s", h(40)), lambda: ("md5: %s", h(32)), lambda: ("uuid %s", f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}"), lambda: ("%s", f"{some(8, hexes)}-{some(4, hexes)}-{some(4, hexes)}-{some(4, hexes)}-{some(12, hexes)}"),
        lambda: ("%s", f"/usr/{word()}/{word()}{some(2, digits)}/{word()}"), lambda: ("https://a.example.com/%s", f"{word()}/{word()}-{some(4, digits)}"), lambda: ("https://%s", f"www.{word()}.org/{word()}/20{some(2, digits)}/{some(2, digits)}/{word()}-{word()}-{some(5, digits)}"), lambda: ("%s.jpg", f"IMG_{some(8, digits)}_{some(4, digits)}"), lambda: ("%s", f"{word()}_{word()}_{some(2, digits)}_{word()}"),
        lambda: ("isbn %s", f"978-{some(1, digits)}-{some(4, digits)}-{some(4, digits)}-{some(1, digits)}"), lambda: ("isbn %s", "978" + some(10, digits)), lambda: ("order %s", f"ORD-20{some(2, digits)}-{some(6, digits)}"), lambda: ("tracking %s", f"{some(1, digits)}Z{some(3, digits)}{some(2, upper)}{some(11, digits)}"), lambda: ("%s", f"{name()}{word()}{some(1, digits)}{word()}"), lambda: ("%s@mail.example.com", f"{word()}{word()}-{some(6, digits)}"),
        lambda: ("version %s", f"{some(1, digits)}-{some(2, digits)}-release-{some(4, digits)}"), lambda: ("%s", f"{word()}-20{some(2, digits)}-{word()}-{some(4, digits)}-{word()}"), lambda: ("%s", f"20{some(6, digits)}T{some(6, digits)}"), lambda: ("token: %s", word() + word()), lambda: ("%s", f"{some(4, digits)}-{some(4, digits)}-{some(4, digits)}-{some(4, digits)}"), lambda: ("auth: %s", r.choice(("required", "optional", "enabled", "disabled", "needed"))),
        lambda: ("%s", some(16, digits) + "+/"), lambda: ("sha256 %s", h(64)), lambda: ("secret: %s", word() + word()), lambda: ("/var/log/%s.gz", f"{word()}log-20{some(6, digits)}"), lambda: ("%s", f"{word()}/{word()}/{some(4, digits)}/{word()}"), lambda: ("secret: %s", word()),
    ]
    table = []
    for k in range(rows):
        form, value = r.choice(secret if k % 2 else clean)()
        text = " ".join([word() for _ in range(r.randint(1, 6))] + [form % value + mark()] + [word() for _ in range(r.randint(0, 5))])
        table.append((text, value, k % 2))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(t)}, {quote(v)}, {y})" for t, v, y in table)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(text, value, is_secret)")


def train(findings: DataFrame, trees: int = 24, depth: int = 6) -> Forest:
    """Fit on labelled findings: candidates of each text, marked by whether they are its labelled value and that a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = findings.withColumn("found", _candidates(F.col("text"))).withColumn("gaps", F.split("text", CANDIDATE))
    rows = found.select("value", "is_secret", F.explode(_described(F.col("found"), F.col("gaps"))).alias("x"))
    y = F.when(F.startswith(F.col("value"), F.col("x.v")) | F.startswith(F.col("x.v"), F.col("value")), F.col("is_secret")).otherwise(0)
    rows = rows.select(_features(F.col("x")).alias("f"), y.cast("double").alias("label")).select("f.*", "label")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label").coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(table)
    return Forest(_trees(model.toDebugString))


def _scanned(docs: DataFrame, forest: Forest, text: str) -> DataFrame:
    """`docs` with _gaps and _found: each candidate with its score and whether it is a secret."""
    own = docs.withColumn("_found", _candidates(F.col(text)))
    own = own.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, CANDIDATE)))
    own = own.withColumn("_found", _described(F.col("_found"), F.col("_gaps")))
    own = own.withColumn("_found", F.transform("_found", lambda x: F.struct(x.alias("x"), _features(x).alias("f"))))
    return own.withColumn("_found", F.transform("_found", lambda x: F.struct(x["x"].alias("x"), forest.score(x["f"]).alias("score"))))


def _kind(v: Column) -> Column:
    kind = F.when(v.rlike("^(AKIA|ASIA)"), "access_key").when(v.rlike("^gh[pousr]_"), "repository_token").when(v.rlike("^(sk|pk|rk)_"), "payment_key")
    return kind.when(v.rlike("^eyJ"), "signed_token").when(v.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("generic")


def find_secrets(docs: DataFrame, forest: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, kind, score, value_sha256) of every finding."""
    none = F.expr("cast(array() as array<struct<start: bigint, v: string, score: double>>)")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(s, y):
        x = y["x"]
        at = s["at"] + x["gap"]
        hit = F.struct((at + F.length(x["p"])).cast("bigint").alias("start"), x["v"].alias("v"), y["score"].alias("score"))
        out = F.when(y["score"] >= CUTOFF, F.concat(s["out"], F.array(hit))).otherwise(s["out"])
        return F.struct((at + F.length(x["m"])).cast("bigint").alias("at"), out.alias("out"))

    some = _scanned(docs.select(key, F.col(text).alias("_text")), forest, "_text").where(F.exists("_found", lambda y: y["score"] >= CUTOFF))
    rows = some.select(key, F.explode(F.aggregate("_found", state, step)["out"]).alias("x"))
    return rows.select(
        key, F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.v")).alias("end"), _kind(F.col("x.v")).alias("kind"), F.col("x.score").alias("score"), F.sha2(F.col("x.v"), 256).alias("value_sha256")
    )


def redacted(docs: DataFrame, forest: Forest, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in the text replaced by `mark`; all other columns as they are."""
    own = _scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text")), forest, "_text")

    def piece(y, i):
        x = y["x"]
        rest = F.substring(x["m"], F.length(x["p"]) + F.length(x["v"]) + 1, F.length(x["m"]))
        return F.concat(F.get(F.col("_gaps"), i), F.when(y["score"] >= CUTOFF, F.concat(x["p"], F.lit(mark), rest)).otherwise(x["m"]))

    clean = F.concat(F.array_join(F.transform("_found", piece), ""), F.element_at("_gaps", -1))
    made = F.when(F.exists("_found", lambda y: y["score"] >= CUTOFF), clean).otherwise(F.col("_text"))
    return own.select(*[made.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
