"""Secret scans with a random forest, as DataFrame expressions.

Candidates are the values after words that announce a secret, of any form from 3 characters on, passwords in URLs, and
elsewhere runs of 16 or more characters of keys and tokens ('=' ends a run but for padding). Each is described by its
length, its character transitions, the shares of its character classes, how much of it dictionary words cover, whether it
looks like a path, and the words around it. A random forest, fitted on labelled findings, tells secrets from hashes,
identifiers, long words, paths and placeholders. Its trees become nested conditions over the features of a candidate,
inside the row that holds the text: finding, judging and masking need no shuffle, no join and no Python on executors.
A text is cut at its candidates once, and what stands around one comes from its neighbours, so that time is in
proportion to the length of a text, whatever it holds.

The labelled findings are a table (before, token, after, label); the default one is made by rule, in SQL, from hashes of
row numbers: keys of several forms next to words that announce them, against checksums, commits, identifiers, paths,
numbers, long words and placeholders. Fitting takes a bounded number of them (FINDINGS) to the driver.

Defined results: null and empty texts have no findings; repeated rows have theirs each; a null doc_id is kept; tokens
that occur several times are findings each, in order; of candidates that touch, the run is one; other columns stay in
``mask`` and are ignored in ``scan``; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import smallest_hashes

#: Labelled findings that are fitted at most, trees, their depth, least findings in a leaf; characters of context.
FINDINGS, TREES, DEPTH, LEAF, CONTEXT = 6000, 15, 6, 8, 40
LEAST = 0.5
_RUN = "A-Za-z0-9_+/-"
#: Words that announce a secret, words that announce something else, and a dictionary.
SECRET_WORDS = "token secret password passwd pwd passphrase apikey api_key api-key access_key accesskey secret_key private_key signing_key encryption_key private credential bearer auth authorization"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum hash digest etag uuid guid revision integrity example sample placeholder dummy changeme version build isbn order tracking phone path file image url http https www"
DICTIONARY = "your the and for with this that from here example sample test demo placeholder change insert value key token secret user name file path data image report version build release document index page model config default public static main class function string number order item customer invoice account tracking"


def _words(words: str) -> str:
    return "(?:" + "|".join(w.replace("-", r"\-") for w in words.split()) + ")"


#: What stands before a value: an announcing word, a sign and a quote; or the user in a URL.
_SAID = f"(?i:{_words(SECRET_WORDS)})"
_SIGN = r"(?:[\"'`]?[ \t]{0,4}(?::=|=>|[:=]|(?i:\bis\b))[ \t]{0,4}|(?<=(?i:bearer))[ \t])"
_USER = r"://[^\s/:@\"'`<>]*:"
_LEAD = rf"(?<![A-Za-z0-9]){_SAID}{_SIGN}"
LEAD = rf"^(?:{_LEAD}[\"'`]?|{_USER})"
#: What quotes hold, or all up to a space or a mark; a run that no announcing word ends.
_VALUE = r"[^\s\"'`,;<>()\[\]{}]{2,}[^\s\"'`,;<>()\[\]{}.:]"
_ANNOUNCED = rf"{_LEAD}(?![\"'`]?{_SAID}{_SIGN})(?:[\"'`](?:[^\"'`\n]{{3,}}(?=[\"'`])|{_VALUE})|{_VALUE})"
_ALONE = rf"(?<![{_RUN}])(?=[{_RUN}]{{16}})(?=[_+/-]*[A-Za-z0-9])(?!(?:[{_RUN}]*[^A-Za-z0-9])?{_SAID}{_SIGN})[{_RUN}]+(?:={{1,2}}(?![{_RUN}=]))?"
CANDIDATE = rf"{_ANNOUNCED}|{_USER}[^\s/@\"'`<>]+(?=@)|{_ALONE}"
#: Values that hold no secret.
BLANK = r"(?i)^(?:[$%<*{].*|x+|none|null|nil|true|false|yes|no|required|optional|missing|invalid|valid|expired|empty|unknown|disabled|enabled|hidden|redacted|masked|changeme|string|text|bearer|basic|not|the|your.*|my.*|example.*|insert.*|placeholder.*)$"


def _any_of(words: str, text: Column) -> Column:
    return text.rlike(f"(?i)(?<![a-z0-9]){_words(words)}(?![a-z0-9])").cast("double")


def _rest(pattern: str, token: Column) -> Column:
    """Characters of the token that the pattern doesn't match."""
    return F.length(F.regexp_replace(token, pattern, ""))


def feature_columns(before: Column, token: Column, after: Column) -> list[tuple[str, Column]]:
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    near = F.substring(before, -18, 18)
    share = lambda pattern: (n - _rest(pattern, token)) / n
    letters = (n - _rest("[A-Za-z]", token)).cast("double")
    changes = lambda a, b: F.size(F.split(token, f"(?<={a})(?={b})|(?<={b})(?={a})")) - 1
    return [
        ("length", n),
        ("letter_digit_changes", changes("[A-Za-z]", "[0-9]") / n),
        ("case_changes", changes("[A-Z]", "[a-z]") / n),
        ("digits", share("[0-9]")),
        ("capitals", share("[A-Z]")),
        ("small", share("[a-z]")),
        ("marks", share("[_+/=-]")),
        ("hexadecimal", share("[0-9a-fA-F]")),
        ("vowels", F.when(letters > 0, (letters - (F.length(F.regexp_replace(F.regexp_replace(token, "[^A-Za-z]", ""), "[aeiouAEIOU]", "")))) / letters).otherwise(0.0)),
        ("distinct", F.size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(32.0))),
        ("dictionary", share("(?i)(?:" + "|".join(sorted(DICTIONARY.split(), key=len, reverse=True)) + ")")),
        ("longest_letters", F.array_max(F.transform(F.split(token, "[^A-Za-z]+"), F.length)).cast("double")),
        ("words", (F.size(F.split(token, r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")) / n)),
        ("consonants", F.array_max(F.transform(F.split(token, "(?i)[^b-df-hj-np-tv-z]+"), F.length)).cast("double")),
        ("path", (F.size(F.split(token, "/")) - 1).cast("double")),
        ("dashes", (F.size(F.split(token, "-")) - 1).cast("double")),
        ("path_before", before.rlike(r"[/.:\\]$").cast("double")),
        ("ending_after", after.rlike(r"^\.[a-z]{2,4}\b").cast("double")),
        ("assigned", before.rlike(r"[=:]\s*[^A-Za-z0-9]{0,6}$").cast("double")),
        ("quoted", before.rlike("[\"'`]$").cast("double")),
        ("secret_word", _any_of(SECRET_WORDS, near)),
        ("other_word", _any_of(OTHER_WORDS, near)),
        ("announced", before.rlike(rf"(?<![A-Za-z0-9]){_SAID}{_SIGN}[\"'`]?$").cast("double")),
        ("in_url", before.rlike(rf"{_USER}$").cast("double")),
        ("blank_value", token.rlike(BLANK).cast("double")),
        ("spaces", (F.size(F.split(token, " ")) - 1).cast("double")),
        ("known_prefix", token.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ)").cast("double")),
    ]


def labelled_findings(spark: SparkSession, count: int = 4800) -> DataFrame:
    """before, token, after and label, by rule, of ``count`` rows."""
    runs = spark.range(count).selectExpr(
        "id", "sha2(cast(id as string), 256) as h", "translate(base64(unhex(sha2(concat('b', id), 512))), '\n', '') as b",
        "pmod(xxhash64(id, 1), 24) as kind", "pmod(xxhash64(id, 2), 8) as word", "pmod(xxhash64(id, 3), 6) as form", "cast(20 + pmod(xxhash64(id, 4), 28) as int) as n",
    ).selectExpr(
        "*", "element_at(array('token', 'api_key', 'secret', 'password', 'access_key', 'auth', 'credential', 'private'), cast(word + 1 as int)) as announce",
        "element_at(array('commit', 'sha256', 'checksum', 'uuid', 'build', 'etag', 'digest', 'revision'), cast(word + 1 as int)) as other",
        "element_at(array(' = \"', '=', ': ', ' = ', ': \"', ' is '), cast(form + 1 as int)) as sign", "element_at(array('and then of the ', 'see the ', '', 'set ', 'tion her and ', 'used with '), cast(pmod(id, 6) + 1 as int)) as lead",
    ).selectExpr(
        "*", """case when kind < 4 then substr(h, 1, n) when kind = 4 then upper(substr(h, 1, n)) when kind < 7 then substr(translate(b, '+/=', 'xyz'), 1, n)
            when kind = 7 then concat('AKIA', upper(substr(translate(b, '+/=', 'QRS'), 1, 16))) when kind = 8 then concat('ghp_', substr(translate(b, '+/=', 'abc'), 1, 36)) when kind = 9 then concat('sk_live_', substr(translate(b, '+/=', 'abc'), 1, 24))
            when kind = 10 then concat('eyJhbGci0i', substr(translate(b, '+/=', 'abc'), 1, 60)) when kind = 11 then substr(b, 1, 40)
            when kind < 15 then substr(h, 1, if(word = 1, 64, 40)) when kind = 15 then concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))
            when kind = 16 then concat('docs/report', id, '/page/image', word) when kind = 17 then concat(element_at(array('your_api_key_here_', 'example_token_value', 'insert-secret-key-', 'placeholder_value_'), cast(pmod(id, 4) + 1 as int)), word, '0')
            when kind = 18 then concat('customerInvoiceNumber', id) when kind = 19 then concat('20', lpad(cast(pmod(id, 90) as string), 2, '0'), '-0', word + 1, '-1', word, '-000', id) when kind = 20 then translate(substr(h, 1, n), 'abcdef', '012345')
            when kind = 21 then repeat(element_at(array('x1', 'X0', '0', '12'), cast(pmod(id, 4) + 1 as int)), 16) when kind = 22 then concat('static/build/version', word, '/index', id) else substr(h, 1, n) end as token""",
    ).selectExpr(
        """case when kind < 12 and (kind < 7 or form < 4) then concat(lead, if(pmod(id, 3) = 0, upper(announce), announce), sign) when kind < 12 then concat(lead, sign)
            when kind < 16 or kind = 23 then concat(lead, other, element_at(array(' ', ': ', ' = ', ':', '=', ' "'), cast(form + 1 as int))) when kind = 17 then concat(lead, announce, sign) else concat(lead, element_at(array('/', ' ', 'of ', '.', 'id ', 'nr. '), cast(form + 1 as int))) end as before""",
        "token", "if(form in (0, 4), '\"', element_at(array(' and', '.', '.html', ' the', '', ','), cast(pmod(id, 6) + 1 as int))) as after", "if(kind < 12, 1, 0) as label",
    )
    return runs.unionByName(_announced_values(spark, count // 4)).unionByName(_letters_and_urls(spark, count // 4))


def _letters_and_urls(spark: SparkSession, count: int) -> DataFrame:
    """Keys of letters alone and passwords in URLs, against long words, names of programs, rules of marks and addresses."""
    part = lambda seed: f"element_at(array('ther', 'ing', 'anti', 'schaft', 'ation', 'ver', 'lich', 'keit', 'ment', 'con', 'able', 'pre', 'sub', 'ous', 'ness', 'ungs'), cast(pmod(xxhash64(id, {seed}), 16) + 1 as int))"
    return spark.range(count).selectExpr(
        "id", "pmod(xxhash64(id, 31), 12) as kind", "cast(20 + pmod(xxhash64(id, 32), 24) as int) as n", "regexp_replace(base64(unhex(concat(sha2(concat('l', id), 512), sha2(concat('m', id), 512)))), '[^A-Za-z]', '') as letters", "sha2(concat('u', id), 256) as h",
        f"{part(33)} as a", f"{part(34)} as b", f"{part(35)} as c", f"{part(36)} as d", f"{part(37)} as e", "element_at(array('the ', 'and then ', 'see ', '', 'of '), cast(pmod(xxhash64(id, 38), 5) + 1 as int)) as lead",
    ).selectExpr(
        "case when kind in (3, 4) then concat(lead, 'postgres://admin:') when kind = 5 then 'http://host:' when kind = 0 then concat(lead, element_at(array('key ', 'using ', 'sign with ', 'is ', 'header '), cast(pmod(id, 5) + 1 as int))) else lead end as before",
        """case kind when 0 then substr(letters, 1, n) when 1 then substr(letters, 1, n) when 2 then concat(substr(letters, 1, n), substr(h, 1, 6)) when 3 then concat(initcap(a), substr(h, 1, 6), '!') when 4 then substr(letters, 1, 12) when 5 then element_at(array('password', 'pass', '$PW', 'user', 'xxxx'), cast(pmod(id, 5) + 1 as int))
            when 6 then concat(a, b, c, d, e) when 7 then initcap(concat(a, b, c, d, e)) when 8 then concat_ws('_', a, b, c, d) when 9 then concat(a, initcap(b), initcap(c), initcap(d), initcap(e)) when 10 then concat_ws('-', a, b, c, d, e) else upper(concat(a, b, c, d, e)) end as token""",
        "element_at(array(' and', '.', '', ',', ' the'), cast(pmod(id, 5) + 1 as int)) as after", "if(kind < 5, 1, 0) as label",
    )


def _announced_values(spark: SparkSession, count: int) -> DataFrame:
    """Short values, words and phrases after announcing words, against values that hold no secret."""
    word = lambda seed: f"element_at(array('river', 'Orange', 'battery', 'staple', 'horse', 'correct', 'Window', 'candle', 'mountain', 'velvet'), cast(pmod(xxhash64(id, {seed}), 10) + 1 as int))"
    return spark.range(count).selectExpr(
        "id", "sha2(concat('v', id), 256) as h", "pmod(xxhash64(id, 11), 10) as kind", "pmod(xxhash64(id, 12), 4) as form", "cast(5 + pmod(xxhash64(id, 13), 12) as int) as n",
        "element_at(array('token', 'password', 'passphrase', 'secret', 'pwd', 'passwd', 'api_key', 'credential'), cast(pmod(xxhash64(id, 14), 8) + 1 as int)) as announce", f"{word(1)} as a", f"{word(2)} as b", f"{word(3)} as c", f"{word(4)} as d",
    ).selectExpr(
        "concat(element_at(array('set ', 'DB_', 'file path ', 'url/build_'), cast(pmod(xxhash64(id, 15), 4) + 1 as int)), if(pmod(id, 3) = 0, upper(announce), announce), case when kind = 9 then ' is ' when kind = 3 then ': \"' else element_at(array(' = \"', '=', ': ', ': \"'), cast(form + 1 as int)) end) as before",
        """case kind when 0 then substr(h, 1, n * if(pmod(id, 2) = 0, 1, 4)) when 1 then concat(a, substr(h, 1, 3)) when 2 then translate(substr(h, 1, n), '0123456789', 'ghijkLMNop') when 3 then concat_ws(' ', a, b, c, d)
            when 4 then concat(a, '!', substr(h, 1, 2), '$') when 5 then concat(a, b) when 6 then element_at(array('none', 'null', 'required', 'invalid', 'expired', 'true', 'changeme', '********'), cast(pmod(id, 8) + 1 as int))
            when 7 then concat(element_at(array('your_', 'my_', 'example_', '${', '<'), cast(pmod(id, 5) + 1 as int)), announce) when 8 then element_at(array('missing', 'optional', 'xxxxxxxx', 'string', 'hidden', '%s'), cast(pmod(id, 6) + 1 as int)) else lower(a) end as token""",
        "if(form in (0, 3) or kind = 3, '\"', element_at(array(' and', '.', ' the', ''), cast(pmod(id, 4) + 1 as int))) as after", "if(kind < 6, 1, 0) as label",
    )


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: (feature, bound, tree for at most, tree for above), or a leaf's share of secrets."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in rng.permutation(x.shape[1])[: 1 + int(np.sqrt(x.shape[1]))]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        impurity = k * left * (1 - left) + (len(y) - k) * right * (1 - right)
        impurity[(v[1:] == v[:-1]) | (k < LEAF) | (len(y) - k < LEAF)] = np.inf
        if len(impurity) and impurity.min() < best[0]:
            i = int(impurity.argmin())
            best = (impurity[i], int(f), float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return share
    at_most = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[at_most], y[at_most], rng, depth - 1), _grow(x[~at_most], y[~at_most], rng, depth - 1)


def fit(findings: DataFrame, seed: int = 21) -> list:
    """The forest's trees, from FINDINGS rows at most (before, token, after, label)."""
    columns = feature_columns(F.col("before"), F.col("token"), F.col("after"))
    rows = findings.select(F.xxhash64("before", "token", "after").alias("h"), F.col("label").cast("int"), *[c.cast("double").alias(n) for n, c in columns])
    rows = smallest_hashes(rows, "h", FINDINGS).toArrow()
    if not len(rows):
        return [0.0]
    x, y = np.stack([rows.column(n).to_numpy() for n, _ in columns], axis=1), rows.column("label").to_numpy().astype(float)
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES):
        at = rng.integers(0, len(y), len(y))
        trees.append(_grow(x[at], y[at], rng, DEPTH))
    return trees


def _tree_column(tree, features: Column, names: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, bound, low, high = tree
    return F.when(features[names[f]] <= bound, _tree_column(low, features, names)).otherwise(_tree_column(high, features, names))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def findings_column(text: str, forest: list, places: bool) -> Column:
    """A struct of the ``parts`` of a text, an array of (gap, lead, token, score, start) for its candidates, and the ``rest``
    after them; gap is the text since the candidate before, start (null unless ``places``) counts characters from 1."""
    x = F.col(text)
    names = [n for n, _ in feature_columns(F.lit(""), F.lit("a"), F.lit(""))]
    at = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))

    def starts(s: Column) -> Column:
        """For each candidate the characters before its gap: sums by block, then within the block."""
        sizes = F.transform(s["pieces"], lambda p, i: F.length(p) + F.length(F.get(s["gaps"], i)))
        sums = lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / 256).cast("int")), lambda b: F.aggregate(F.slice(z, b * 256 + 1, F.lit(256)), F.lit(0), lambda m, v: m + v))
        run = lambda z, a, n: F.aggregate(F.slice(z, a, n), F.lit(0), lambda m, v: m + v)
        both = lambda z: _bound(F.struct(z.alias("z"), sums(z).alias("sums")), lambda t: _bound(F.struct(t["z"].alias("z"), F.transform(t["sums"], lambda _, b: run(t["sums"], F.lit(1), b)).alias("base")), lambda u: F.transform(u["z"], lambda _, i: F.get(u["base"], F.floor(i / 256).cast("int")) + run(u["z"], F.floor(i / 256).cast("int") * 256 + 1, i % 256))))
        return _bound(sizes, both)

    def described(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            lead = F.regexp_extract(p, LEAD, 0)
            token = F.substr(p, F.length(lead) + 1)
            before = F.substring(F.concat(F.substring(at(s["pieces"], i - 1), -CONTEXT, CONTEXT), F.get(s["gaps"], i), lead), -CONTEXT, CONTEXT)
            after = F.substring(F.concat(F.get(s["gaps"], i + 1), at(s["pieces"], i + 1)), 1, 8)
            start = F.get(s["starts"], i) + F.length(F.get(s["gaps"], i)) + F.length(lead) + 1 if places else F.lit(None).cast("int")
            return F.struct(F.get(s["gaps"], i).alias("gap"), lead.alias("lead"), token.alias("token"), before.alias("before"), after.alias("after"), start.alias("start"))

        return F.transform(s["pieces"], one)

    def judged(c: Column) -> Column:
        f = F.struct(*[v.cast("double").alias(n) for n, v in feature_columns(c["before"], c["token"], c["after"])])
        votes = lambda f: sum((_tree_column(t, f, names) for t in forest[1:]), _tree_column(forest[0], f, names)) / float(len(forest))
        return F.struct(c["gap"].alias("gap"), c["lead"].alias("lead"), c["token"].alias("token"), _bound(f, votes).alias("score"), c["start"].alias("start"))

    # Candidates and the text between them come from the same pattern.
    cut = F.struct(F.regexp_extract_all(x, F.lit(CANDIDATE), F.lit(0)).alias("pieces"), F.split(x, CANDIDATE, -1).alias("gaps"))
    with_starts = lambda s: F.struct(s["pieces"].alias("pieces"), s["gaps"].alias("gaps"), (starts(s) if places else F.lit(None)).alias("starts"))
    return _bound(_bound(cut, with_starts), lambda s: F.struct(F.transform(described(s), judged).alias("parts"), F.element_at(s["gaps"], -1).alias("rest")))


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``start``, ``length``, ``secret`` and ``score`` for each secret found in ``docs``."""
    found = docs.select(id_col, text_col).where(F.col(text_col).rlike(CANDIDATE)).select(id_col, findings_column(text_col, forest, True)["parts"].alias("__parts"))
    each = found.select(id_col, F.explode(F.filter("__parts", lambda c: c["score"] >= LEAST)).alias("s"))
    return each.select(id_col, F.col("s.start").alias("start"), F.length("s.token").alias("length"), F.col("s.token").alias("secret"), F.col("s.score").alias("score"))


def mask(docs: DataFrame, forest: list, text_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in its text replaced."""
    said = lambda c: F.concat(c["gap"], c["lead"], F.when(c["score"] >= LEAST, F.lit(by)).otherwise(c["token"]))
    whole = _bound(findings_column(text_col, forest, False), lambda f: F.concat(F.array_join(F.transform(f["parts"], said), ""), f["rest"]))
    # Texts without a candidate are never taken apart.
    return docs.withColumn(text_col, F.when(F.col(text_col).rlike(CANDIDATE), whole).otherwise(F.col(text_col)))
