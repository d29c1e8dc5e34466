"""Secret scans: pattern candidates, cleared of false positives by a random forest.

Candidates are runs of 16 or more key characters with a digit among them,
values of any length given to a name that holds password, token, secret, key
and the like (quoted or not, in an address up to the next parameter), words
after bearer, and headers of private keys.  Features: length,
shares and transitions of character classes, common letter pairs, dictionary
coverage, the path, and the neighbouring words.  The forest is trained on a
table of labelled findings (by default LABELLED rows generated by rule, or the
caller's) and then becomes one SQL expression that is evaluated beside the
text, so scanning is one projection without shuffle, join or Python.

Defined results: a null or empty text has no findings; very long texts are
scanned whole; a score on the threshold is a secret; repeated rows, and rows
with a null id, are scanned one by one; findings are numbered from 0 within a
row, and ``start`` counts characters from 0; the path is the column ``source``,
null or absent is empty; an empty table gives an empty result; other columns
are not read (``op4``) or passed through (``redact``).
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import barrier

#: Rows of the default training table.
LABELLED = 3000
TREES, DEPTH, SEED = 16, 6, 11
THRESHOLD = 0.5
MASK = "[SECRET]"
_NAME = "(?=[pPtTsScCaAkK])(?:(?i:passw|passphrase|pwd|token|secret|credential|api[_.-]?key|access[_.-]?key|private[_.-]?key)|(?<![A-Za-z])(?i:key)|(?<=[a-z])Key)"
_PLAIN_NAME = "(?i:passw|passphrase|pwd)"
_TAIL = "[A-Za-z0-9_.-]{0,64}+"
_GIVEN = "[\"']?[ \\t]*+(?:=>|:=|={2,3}(?=[ \\t\"'])|[:=](?!=))[ \\t]*+[\"']?"
_BEARER = "(?i:\\bbearer)[ \\t]++"
_ASSIGN = f"(?:{_NAME}{_TAIL}{_GIVEN}|{_BEARER})(?=[^\\s\"'])"
#: Values: of a password anything up to a blank or quote, of other names no separators of lists and code.
_VALUE = "[^\\s\"'=,;&<>(){}\\[\\]\\\\`|]++(?:={1,2}(?![A-Za-z0-9]))?"
_IN_ADDRESS = f"{_NAME}{_TAIL}(?<=[?&][A-Za-z0-9_.-]{{0,99}})=[^\\s\"'&#]+"
_GIVEN_VALUE = f"(?:{_IN_ADDRESS}|(?={_PLAIN_NAME}){_NAME}{_TAIL}{_GIVEN}[^\\s\"']+|{_NAME}{_TAIL}{_GIVEN}{_VALUE})"
CANDIDATE = (
    "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    f"|{_GIVEN_VALUE}|{_BEARER}{_VALUE}"
    # a run that is itself such a name, with a value after it, leaves the place to the value
    f"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?![A-Za-z0-9+/_-]*?{_GIVEN_VALUE})[A-Za-z0-9+/_-]{{16,}}+={{0,2}}"
)
_WORDS = (
    "about|access|address|admin|after|author|article|backup|branch|build|button|cache|change|check|class|client|close|color|column"
    "|comment|config|content|count|create|data|date|default|delete|demo|document|down|error|event|example|export|field|file|filter"
    "|first|folder|format|function|group|handler|header|home|html|icon|image|import|index|input|item|json|label|last|layout|left"
    "|level|library|line|link|list|local|login|main|manager|master|menu|message|method|model|module|name|network|news|node|number"
    "|object|option|order|page|panel|parent|password|path|place|player|plugin|point|post|price|process|product|profile|project"
    "|public|query|random|read|record|release|report|request|result|right|sample|script|search|section|select|server|service"
    "|session|setting|site|size|source|start|state|static|status|storage|string|style|system|table|target|task|template|test"
    "|text|theme|time|title|token|type|update|upload|user|value|version|video|view|week|widget|window|word|world|year|your"
)
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne"
_KEYWORD = "token|secret|passw|passwd|pwd|credential|auth|bearer|api.?key|access.?key|private.?key|key"
_NOISE = "sha1|sha256|sha512|sha|md5|commit|checksum|digest|uuid|guid|revision|rev|hash|integrity|etag|build|serial|order|invoice|isbn|phone|card"

#: Feature -> SQL over {v} (value), {b} and {a} (text before and after), {p} (path).
FEATURES: dict[str, str] = {
    "length": "least(length({v}), 400)",
    "digits": "regexp_count({v}, '[0-9]') / length({v})",
    "upper": "regexp_count({v}, '[A-Z]') / length({v})",
    "lower": "regexp_count({v}, '[a-z]') / length({v})",
    "hexed": "int({v} rlike '^[0-9a-f]+$')",
    "uuid": "int({v} rlike '^(?i)[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$')",
    "transitions": "regexp_count({v}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / length({v})",
    "pairs": f"regexp_count(lower({{v}}), '(?=({_PAIRS}))') / length({{v}})",
    "dictionary": f"1 - length(regexp_replace(lower({{v}}), '{_WORDS}', '')) / length({{v}})",
    "distinct": "size(array_distinct(split({v}, ''))) / least(length({v}), 40)",
    "fake": "int({v} rlike '(?i)example|xxxx|dummy|placeholder|your|changeme|sample|12345678|abcdefgh|00000000|<|>|\\\\*\\\\*')",
    "known": "int({v} rlike '^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abpr]-|sk_live_|AIza|-----BEGIN)')",
    "keyword": f"int({{b}} rlike '(?i)({_KEYWORD})[^A-Za-z]{{{{0,8}}}}$')",
    "keyword_near": f"int({{b}} rlike '(?i)({_KEYWORD})')",
    "noise": f"int({{b}} rlike '(?i)({_NOISE})[^A-Za-z]{{{{0,8}}}}$')",
    "assigned": "int({b} rlike '[:=][ \\\\t]*[\"\\']?$')",
    "quoted": "int({b} rlike '[\"\\']$' AND {a} rlike '^[\"\\']')",
    "path_noise": "int({p} rlike '(?i)test|example|sample|fixture|mock|[.]lock$|[.]min[.]|vendor|docs?/')",
    "path_config": "int({p} rlike '(?i)[.](env|ya?ml|ini|conf|cfg|properties|pem|key)$|config|secret')",
}


def features(v: str, b: str, a: str, p: str) -> dict[str, str]:
    return {name: f"CAST({sql.format(v=v, b=b, a=a, p=p)} AS DOUBLE)" for name, sql in FEATURES.items()}


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(v, b, a, path, label): findings by rule, drawn from digests of the row number."""
    hex_ = "sha2(concat('h', id), 256)"
    b64 = "replace(replace(base64(unhex(sha2(concat('b', id), 512))), '+', '-'), '/', '_')"
    num = "lpad(cast(pmod(xxhash64(id), 10000000000000000) AS string), 16, '4')"
    size = "CAST(20 + pmod(xxhash64(id, 1), 40) AS INT)"
    pick = lambda *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), CAST(1 + pmod(xxhash64(id, 2), {len(xs)}) AS INT))"
    word = f"concat_ws('_', {pick('update', 'select', 'page', 'user', 'build')}, {pick('handler', 'version', 'template')}, 'module', id, {pick('item', 'list')})"
    good_path = pick("src/app.py", "config/prod.yml", "src12", ".env", "settings.ini", "", "deploy/main.tf")
    any_path = pick("src/app.py", "src3", "package.lock", "docs/guide.md", "", "tests/test_auth.py", "index.min.js")
    key = pick("token = \"", "and token = \"", "api_key: '", "secret=\"", "ACCESS_KEY=\"", "auth_token = '", "client_secret: \"")
    bare = pick("GITHUB_TOKEN=", "api_key=", "?token=", "client_secret=", "export SECRET_KEY=", "AWS_SECRET_ACCESS_KEY=", "auth_token: ", "DB_PASSWORD=", "my_password = ", "apiKey: ")
    named = pick("token: ", "token = ", "key: ", "secret: ", "password: ", "api_key=", "access_token = ", "the bearer ", "auth_token = \"", "secret_name: ")
    code = pick("none", "true", "null", "string", "required", "self.token", "config.get", "user_token", "undefined", "value", "access_token", "os.environ", "request.headers.get", "get_password", "$", "str", "name", "primary", "settings.API_KEY", "optional").replace("xxhash64(id, 2)", "xxhash64(id, 5)")
    prose = "concat(" + ", ".join(f"element_at(array('the','er','on','ti','re','and','es','ment','la','que','ing','de'), CAST(1 + pmod(xxhash64(id, {k}), 12) AS INT))" for k in (3, 4)) + ", if(id % 2 = 0, '', '.'))"
    kinds = [
        (f"left({hex_}, CAST(32 + 8 * pmod(id, 3) AS INT))", key, "\"", good_path, 1),
        (f"left({b64}, {size})", key, "\"", good_path, 1),
        (f"left({b64}, {size})", pick("password = ", "Authorization: Bearer ", "passwd: ", "pwd="), "\\n", good_path, 1),
        (f"left({b64}, CAST(8 + pmod(id, 7) AS INT))", pick("password = ", "password: \"", "passwd = '", "pwd="), " ", good_path, 1),
        (f"concat('AKIA', upper(left({hex_}, 16)))", pick("aws: ", "", "id = \"", "the key is ", "AWS=", "AWS_ACCESS_KEY_ID="), "\"", good_path, 1),
        (f"concat('ghp_', left(replace({b64}, '-', 'x'), 36))", pick("", "push with ", "git: ", "GITHUB_TOKEN="), " ", any_path, 1),
        (f"left({b64}, {size})", bare, "\\n", good_path, 1),
        (f"left({hex_}, CAST(16 + pmod(id, 48) AS INT))", bare, "&", any_path, 1),
        (f"left({b64}, CAST(8 + pmod(id, 9) AS INT))", bare, "\\n", good_path, 1),
        (f"left(translate({b64}, '0123456789-_', 'qzxjkvwQZXJK'), CAST(12 + pmod(id, 30) AS INT))", bare, " ", any_path, 1),
        (f"left(translate({b64}, '0123456789-_', 'qzxjkvwQZXJK'), CAST(12 + pmod(id, 30) AS INT))", key, "\"", good_path, 1),
        (code, named, " ", any_path, 0),
        (prose, named, " ", any_path, 0),
        (word, named, "(", any_path, 0),
        (hex_, pick("sha256: ", "sha256=", "checksum \"", "digest: \""), " ", any_path, 0),
        (f"left({hex_}, 40)", pick("commit ", "merged at revision ", "sha1 ", "rev "), " and", any_path, 0),
        (f"concat_ws('-', left({hex_}, 8), substr({hex_}, 9, 4), substr({hex_}, 13, 4), substr({hex_}, 17, 4), substr({hex_}, 21, 12))", pick("uuid: ", "id = \"", "request ", "guid "), "\"", any_path, 0),
        (num, pick("of the ", "order number ", "card ", "and "), " in", any_path, 0),
        (word, pick("call ", "def ", "see ", "id=\""), "(", any_path, 0),
        (f"concat('your-token-here-', pmod(id, 1000))", key, "\"", any_path, 0),
        (f"concat('example', left({hex_}, 20))", key, "\"", any_path, 0),
        (f"concat('sha512-', left({b64}, 60), '==')", pick("\"integrity\": \"", "integrity=\""), "\"", any_path, 0),
        (f"concat('articles/2024/', pmod(id, 12), '/', {word})", pick("https://site.example/", "see ", "href=\"/"), "\"", any_path, 0),
    ]
    choose = lambda at: "CASE pmod(id, {}) {} END".format(len(kinds), " ".join(f"WHEN {n} THEN {at(k)}" for n, k in enumerate(kinds)))
    text = lambda s: s if s.startswith("element_at") else "'" + s.replace("'", "\\'") + "'"
    return spark.range(0, rows, 1, 2).selectExpr(
        f"{choose(lambda k: k[0])} AS v",
        f"{choose(lambda k: text(k[1]))} AS b",
        f"{choose(lambda k: text(k[2]))} AS a",
        f"{choose(lambda k: k[3])} AS path",
        f"{choose(lambda k: str(k[4]))} AS label",
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[tuple]:
    """The forest of ``findings`` (v, b, a, path, label 0/1) as nested (feature, threshold, low, high) or a class."""
    names = list(FEATURES)
    rows = findings.selectExpr(*[f"{sql} AS {name}" for name, sql in features("v", "b", "a", "path").items()], "CAST(label AS DOUBLE) AS label")
    table = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64)
    return parse_forest(forest.fit(table).toDebugString, names)


def parse_forest(text: str, names: list[str]) -> list[tuple]:
    """Trees from the printed form of a forest."""
    lines = [x.strip() for x in text.splitlines()]
    starts = [k for k, x in enumerate(lines) if re.match(r"Tree \d+", x)]

    def node(k: int):
        if m := re.match(r"Predict: ([\d.eE+-]+)", lines[k]):
            return float(m[1]), k + 1
        m = re.match(r"If \(feature (\d+) <= ([\d.eE+-]+)\)", lines[k])
        low, k = node(k + 1)
        high, k = node(k + 1)  # after "Else (...)"
        return (names[int(m[1])], float(m[2]), low, high), k

    return [node(k + 1)[0] for k in starts]


def forest_sql(trees: list[tuple], of: str) -> str:
    """Share of the trees that vote for a secret; ``of``: the struct that holds the features."""

    def tree(t) -> str:
        if not isinstance(t, tuple):
            return f"{t:.1f}D"
        return f"CASE WHEN {of}.{t[0]} <= {t[1]!r}D THEN {tree(t[2])} ELSE {tree(t[3])} END"

    return f"({' + '.join(tree(t) for t in trees)}) / {float(len(trees))!r}D"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


BLOCK = 256


def scanned(docs: DataFrame, findings: DataFrame | None = None, only_found: bool = False) -> DataFrame:
    """``docs`` with ``__m`` (candidates), ``__s`` (the texts between) and ``__f``:
    array<struct<start, value, score>> in the order of ``__m``; ``only_found``: rows with candidates only."""
    trees = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    path = "coalesce(CAST(source AS STRING), '')" if "source" in docs.columns else "''"
    one = docs.withColumn(
        "__m", F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>"))
    )
    one = barrier(one).where("size(__m) > 0") if only_found else barrier(one)
    two = one.withColumn("__s", F.when(F.size("__m") > 0, F.split("text", CANDIDATE, -1))).withColumn("__p", F.expr(path))
    prefix = f"regexp_extract(x, {_quoted('^(' + _ASSIGN + ')')}, 1)"
    parts = two.withColumn(
        "__c",
        F.expr(
            f"transform(__m, (x, i) -> struct({prefix} AS pre, x, get(__s, i) AS before, left(get(__s, i + 1), 30) AS a,"
            " length(get(__s, i)) + length(x) AS n))"
        ),
    )
    blocks = parts.withColumn(
        "__b",
        F.expr(
            f"transform(sequence(0, size(__c) div {BLOCK}), k -> aggregate(slice(__c, 1, k * {BLOCK}), 0L, (s, c) -> s + c.n))"
        ),
    )
    values = blocks.withColumn(
        "__v",
        F.expr(
            f"""transform(__c, (c, i) -> struct(
                get(__b, i div {BLOCK}) + aggregate(slice(__c, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (s, y) -> s + y.n)
                    + length(c.before) + length(c.pre) AS start,
                substr(c.x, length(c.pre) + 1) AS v, right(concat(right(c.before, 60), c.pre), 60) AS b, c.a AS a))"""
        ),
    )
    sql = ", ".join(f"{x} AS {name}" for name, x in features("y.v", "y.b", "y.a", "__p").items())
    measured = values.withColumn("__x", F.expr(f"transform(__v, y -> struct(y.start AS start, y.v AS v, {sql}))"))
    scored = measured.withColumn("__f", F.expr(f"transform(__x, y -> struct(y.start AS start, y.v AS value, {forest_sql(trees, 'y')} AS score))"))
    return barrier(scored).drop("__p", "__c", "__b", "__v", "__x")


def findings_of(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, finding, start, value, score and is_secret."""
    own = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    rows = scanned(docs.select(*own), findings, only_found=True).select("doc_id", F.posexplode("__f").alias("finding", "f"))
    return rows.select("doc_id", "finding", "f.start", "f.value", "f.score", (F.col("f.score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by MASK; other texts and columns as they were."""
    names = {c: f"__o{k}" for k, c in enumerate(docs.columns) if c.lower() not in ("text", "source")}
    inner = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
    rows = scanned(inner, findings)
    masked = F.expr(
        f"""concat(array_join(transform(__m, (x, i) -> concat(get(__s, i),
            CASE WHEN get(__f, i).score >= {THRESHOLD!r}D
                 THEN concat(left(x, length(x) - length(get(__f, i).value)), '{MASK}') ELSE x END)), ''), get(__s, size(__m)))"""
    )
    text = F.when(F.exists("__f", lambda f: f["score"] >= THRESHOLD), masked).otherwise(F.col("text"))
    return rows.select(*[(text if c == "text" else F.col(names.get(c, f"`{c}`"))).alias(c) for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    """Every candidate with its verdict; values only as digests."""
    rows = findings_of(docs)
    return rows.select("doc_id", "finding", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
