"""Secret scanning: a random forest removes the false positives among pattern matches.

Candidates are long words, and what is assigned to a password. Their features are binned, a
forest is grown level by level from grouped counts of labelled findings, and its trees become one SQL
expression. DataFrame functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

_BODY = r"A-Za-z0-9+/_\-"
#: Behind a password's key word (which a quote may close) and separator; the one character first, as it is the cheaper.
_ASSIGNED = r"(?<=[ \t:=>\"'])(?![\s:=>\"'])(?i:(?<=(?:password|passwd|pwd|secret)[\"']?[ \t:=>]{1,8}[\"']?))"
#: What is assigned in quotes; a long word; what is assigned without quotes, up to the next name of a list as in a URL.
CANDIDATE = rf"(?<=[\"']){_ASSIGNED}[^\s\"']{{8,}}+(?=[\"'])|(?<![{_BODY}])[{_BODY}]{{16,}}+={{0,2}}|{_ASSIGNED}(?:(?![;,&][\w.\-]{{1,64}}[=:])[^\s\"']){{8,}}+"
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|credential|bearer)"
OTHER_WORDS = r"(?i)(sha\d*|commit|checksum|digest|md5|hash|uuid|guid|isbn|order|invoice|phone|card|image|base64|integrity|revision|blob|example|sample|dummy|test)"
PATH_WORDS = r"(?i)(test|fixture|example|sample|lock|min\.js|\.map|vendor|docs?/|\.md$)"
DICTIONARY = ["the", "and", "for", "with", "this", "that", "from", "have", "section", "chapter", "version", "number", "page", "image", "data", "file", "path", "user", "name", "home", "lib", "usr", "python", "dist", "packages", "example", "test", "config", "value", "index", "node", "modules", "part", "time", "date", "main", "class", "function", "placeholder", "change", "your", "here", "xxxx", "default", "local", "share", "tion", "ing", "key", "token", "secret", "password"]
BINS = 16
FEATURES = ("length", "digits", "upper", "lower", "switches", "variety", "hex", "vowels", "coverage", "secret_word", "other_word", "assigned", "quoted", "path", "separators", "placeholder")


def candidates(docs: DataFrame, path: str | None = None, context: int = 48) -> DataFrame:
    """doc_id, ordinal, start, candidate, before, after, path for each candidate in the whole texts of docs.

    start counts characters from 0. Rows that repeat both id and text count once.
    """
    own = docs.filter(F.col("text").rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.col(path).cast("string") if path else F.lit(None).cast("string"), F.lit("")).alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("m"), F.split("text", CANDIDATE, -1).alias("gaps"))
    gap = lambda c: F.struct(F.length(c).alias("n"), F.right(c, F.lit(context)).alias("end"), F.left(c, F.lit(context)).alias("begin"))
    own = own.withColumn("gaps", F.transform("gaps", gap)).dropDuplicates(["doc_id", "th", "path"])
    one = F.transform("m", lambda c, i: F.struct(c.alias("candidate"), F.element_at("gaps", i + 1)["n"].alias("gap"), F.element_at("gaps", i + 1)["end"].alias("before"), F.element_at("gaps", i + 2)["begin"].alias("after")))
    rows = own.select("doc_id", "th", "path", F.posexplode(one).alias("ordinal", "c")).select("doc_id", "th", "path", "ordinal", "c.*")
    upto = Window.partitionBy("doc_id", "th", "path").orderBy("ordinal")
    start = F.sum(F.col("gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return rows.select("doc_id", "ordinal", start.cast("long").alias("start"), "candidate", "before", "after", "path")


def features(rows: DataFrame) -> DataFrame:
    """rows with f, the binned features in the order of FEATURES."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda p: (F.regexp_count(c, F.lit(p)) * (BINS - 1) / n)
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    switches = F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    known = n - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    values = [
        n / 4, share("[0-9]"), share("[A-Z]"), share("[a-z]"), switches * (BINS - 1) / n,
        F.size(F.array_distinct(F.split(c, ""))) / 3, flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & c.rlike("(?i)[a-f]")), share("[aeiouAEIOU]") * 2,
        known * (BINS - 1) / n, flag(F.col("before").rlike(SECRET_WORDS)), flag(F.col("before").rlike(OTHER_WORDS)), flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
        flag(F.col("before").rlike("[\"']$")), flag(F.col("path").rlike(PATH_WORDS)), F.regexp_count(c, F.lit(r"[_/\-]")) * 2, flag(c.rlike(r"(?i)(xxx|example|dummy|placeholder|changeme|1234|0000|(.)\2\2\2)")),
    ]
    return rows.withColumn("f", F.array(*[F.least(F.lit(BINS - 1), F.floor(v)).cast("int") for v in values]))


def labelled_findings(spark: SparkSession, n: int = 2400) -> DataFrame:
    """text, path, is_secret: n labelled findings of 19 kinds, made here from hashes; for where no own ones exist."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")).cast("binary"), 512)
    hx = lambda a, m: F.substring(h, a, m)
    b64 = lambda a, m: F.substring(F.regexp_replace(F.base64(F.unhex(h)), "[+=]", "x"), a, m)
    q = F.when(F.col("id") % 2 == 0, '"').otherwise("'")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64("id"), F.lit(len(x))) + 1).cast("int"))
    digits = lambda a, m: F.substring(F.regexp_replace(F.concat(h, h), "[a-f]", ""), a, m)
    capitals = F.concat(F.translate(hx(1, 8), "0123456789abcdef", "ABCDEFGHIJKLMNOP"), F.translate(hx(9, 8), "0123456789abcdef", "KLMNOPQRSTUVWXYZ"))
    letters = lambda a, m: F.translate(b64(a, m), "0123456789+/", "kQzWxJvBqNgR")
    word = lambda a, m: F.translate(hx(a, m), "0123456789abcdef", "aeiouetnrsldhcgm")
    kinds = [
        (True, F.concat(pick("token", "auth_token", "TOKEN", "secret", "access_token"), F.lit(" = "), q, hx(1, 40), q)),
        (True, F.concat(pick("api_key: ", "apikey=", "API_KEY = ", "client_secret: "), q, b64(1, 36), q)),
        (True, F.concat(F.lit("aws_access_key_id = AKIA"), F.upper(hx(5, 16)))),
        (True, F.concat(pick("password: ", "passwd=", "pwd = ", "secret: "), q, b64(3, 12), hx(2, 4), q)),
        (False, F.concat(pick("commit ", "sha1: ", "checksum = ", "revision ", "blob ", "see "), hx(9, 40))),
        (False, F.concat(pick("uuid ", "id: ", "guid = "), hx(1, 8), F.lit("-"), hx(9, 4), F.lit("-"), hx(13, 4), F.lit("-"), hx(17, 4), F.lit("-"), hx(21, 12))),
        (False, F.concat(pick("", "card ", "order ", "call ", "nr "), digits(1, 16))),
        (False, F.concat(pick("see ", "= ", "in "), pick("section_12_of_chapter_", "test_data_file_name_", "version_of_the_package_", "user_name_index_part_"), digits(1, 2), pick("_intro", "_main", "_page_2"))),
        (False, F.concat(pick("open ", "path: ", ""), pick("/usr/lib/python3/dist-packages/", "home/user/local/share/data", "node_modules/lib/index"), digits(3, 1), pick("/name", "/config", ""))),
        (False, F.concat(pick("api_key = ", "token: ", "password="), q, pick("xxxxxxxxxxxx1234example", "your-token-here-0000000", "changeme1234placeholder", "example_key_1234567890"), q)),
        (False, F.concat(F.lit("image: data:image/png;base64,"), b64(1, 64))),
        (False, F.concat(pick("isbn ", "phone ", "tel. "), digits(1, 3), F.lit("-"), digits(4, 4), F.lit("-"), digits(8, 4), F.lit("-"), digits(12, 4))),
        (True, F.concat(pick("aws_access_key_id = ", "access_key: ", "AWS_ACCESS_KEY_ID="), pick("AKIA", "ASIA"), capitals)),
        (True, F.concat(pick("api_key: ", "apikey=", "token = ", "client_secret: "), q, letters(1, 36), q)),
        (True, F.concat(F.lit('{"'), pick("password", "passwd", "db_password", "secret"), F.lit('": "'), b64(1, 5), pick("!", "$", "#", "%"), b64(9, 4), pick("=", ":", "?", ""), hx(2, 2), F.lit('"}'))),
        (True, F.concat(pick("password = ", "secret: ", "pwd="), q, b64(1, 30), pick("!", "$", "#", "%"), b64(31, 30), pick("@", "*", "~"), b64(61, 20), q)),
        (False, F.concat(pick("the ", "see ", "= ", "a "), pick("internationalization", "incomprehensibilities", "Donaudampfschifffahrt", word(1, 16), word(5, 17), word(9, 18), word(13, 20), F.initcap(word(17, 16))))),
        (False, F.concat(pick("call ", "see ", "set ", "in "), pick("AbstractSingletonProxyFactory", "MAXIMUM_NUMBER_OF_ITEMS", "state-of-the-art-technology", "get_user_name_from_path", "----------------------", "/usr/local/share/applications"))),
        (False, F.concat(pick("the secret ", "your password ", "a secret = ", "password: "), pick("agreement", "protection", "required", "ingredient", "documents", "settings", "optional"))),
    ]
    text, good = F.lit(""), F.lit(False)
    for i, (own, t) in enumerate(kinds):
        text, good = F.when(F.col("id") % len(kinds) == i, t).otherwise(text), F.when(F.col("id") % len(kinds) == i, own).otherwise(good)
    around = lambda: pick("the thing of ", "", "in that er ", "const x; ", "est la ")
    path = F.when(good, pick("config/prod.env", "src/app.py", "", "deploy.yaml", "src3")).otherwise(pick("tests/fixtures/a.json", "yarn.lock", "", "src/app.py", "docs/a.md", "src7"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(around(), text, pick(" and so on", "", "\nnext", " x")).alias("text"), path.alias("path"), good.alias("is_secret"))


def _walk(tree: dict, node: int, value, f: Column) -> Column:  # noqa: ANN001
    if node not in tree:
        return value(node)
    j, b = tree[node]
    return F.when(f[j] <= b, _walk(tree, 2 * node, value, f)).otherwise(_walk(tree, 2 * node + 1, value, f))


def grow_forest(rows: DataFrame, trees: int = 12, depth: int = 5, tried: int = 5, least: int = 4) -> list[tuple[dict, dict]]:
    """(splits, leaf values) of each tree, from rows (id, f, y).

    Each level is one grouped count of (tree, node, feature, bin); what reaches the driver is bounded by
    trees * 2**depth * features * bins, whatever the rows. Bootstrap weights and tried features come from hashes.
    """
    draw = F.pmod(F.xxhash64("id", "tree"), F.lit(10))
    own = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    own = stored(own.withColumn("w", F.when(draw < 4, 0).when(draw < 8, 1).when(draw < 9, 2).otherwise(3)).filter("w > 0").select("tree", "w", "y", "f"), "bootstrap")
    splits: list[dict] = [{} for _ in range(trees)]
    leaves: list[dict] = [{} for _ in range(trees)]
    for level in range(depth + 1):
        node = F.lit(1)
        for t, s in enumerate(splits):
            if s:
                node = F.when(F.col("tree") == t, _walk(s, 1, F.lit, F.col("f"))).otherwise(node)
        at = own.withColumn("node", node).filter(F.col("node") >= 2**level)
        stats: dict = {}
        for r in at.select("tree", "node", "w", "y", F.posexplode("f").alias("j", "bin")).groupBy("tree", "node", "j", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect():
            stats.setdefault((r["tree"], r["node"]), {}).setdefault(r["j"], {})[r["bin"]] = (r["n"], r["p"])
        for (t, k), by in sorted(stats.items()):
            n, p = (sum(x[i] for x in by[min(by)].values()) for i in (0, 1))
            leaves[t][k] = (p + 1) / (n + 2)
            if level == depth or p in (0, n) or n < 2 * least:
                continue
            gini = lambda a, b: 2 * b * (a - b) / a if a else 0.0
            best = None
            order = sorted(by, key=lambda j: (j * 7919 + t * 104729 + k * 1299709) * 2654435761 % 2**32)
            for j in order[:tried] if len(order) > tried else order:
                ln = lp = 0
                for b in sorted(by[j])[:-1]:
                    ln, lp = ln + by[j][b][0], lp + by[j][b][1]
                    if ln >= least and n - ln >= least:
                        gain = gini(n, p) - gini(ln, lp) - gini(n - ln, p - lp)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, j, b)
            if best:
                splits[t][k] = best[1:]
    return list(zip(splits, leaves, strict=True))


def forest_score(forest: list[tuple[dict, dict]], f: Column) -> Column:
    """The mean of the trees' leaf values, 0 to 1."""
    out = F.lit(0.0)
    for splits, leaves in forest:
        out = out + _walk(splits, 1, lambda k, leaves=leaves: F.lit(float(leaves.get(k, 0.5))), f)
    return out / max(1, len(forest))


def train(findings: DataFrame, **options) -> list[tuple[dict, dict]]:
    """A forest from labelled findings (text, path, is_secret); each row's candidates carry its label."""
    ids = findings.withColumn("doc_id", F.xxhash64("text", "path"))
    rows = features(candidates(ids, "path")).join(ids.groupBy("doc_id").agg(F.max("is_secret").alias("y")), "doc_id")
    return grow_forest(rows.select(F.xxhash64("doc_id", "ordinal").alias("id"), "f", F.col("y").cast("int").alias("y")), **options)


def scan(docs: DataFrame, forest: list[tuple[dict, dict]], path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal, start, length, sha256, score, is_secret for each candidate in docs (doc_id, text, ...).

    The candidate itself is not repeated in the result. A null or empty text has none; rows that repeat both id
    and text count once; without a path column its features say nothing. Empty tables give an empty result.
    """
    rows = features(candidates(docs, path if path in docs.columns else None))
    rows = rows.withColumn("score", forest_score(forest, F.col("f")))
    return rows.select("doc_id", "ordinal", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))
