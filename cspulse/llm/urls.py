"""URL filtering: fixed rules, and for the rest a classifier of host and path, in DataFrame operations only.

The classifier is a logistic regression on hashed character n-grams of the host
and, apart from them, of the path.  It is trained from a small labelled URL
table (LABELLED, or the caller's) with Spark ML; its coefficients are one array
of DIMS numbers, and scoring is a sum over a URL's n-grams.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import once, unused

DIMS = 1 << 15
#: Lengths of the n-grams; host and path are bounded by "^" and "$".
NGRAMS = (3, 4, 5)
#: Rows of the labelled table that training reads at most.
MAX_LABELLED = 10_000
REGULARIZATION = 0.0005
#: A URL is blocked from this probability on.
THRESHOLD = 0.5

# Rules (allowed, host, path); the longest that fits decides.
RULES = ((True, "com", "/"), (False, "example.com", "/en/"), (True, "www.example.com", "/en/"),
         (False, "net", "/es/"), (False, "net", "/fr/"))

# Words of hosts that are blocked, by subject, and of hosts that are allowed; the labelled table is made of them.
BLOCKED_WORDS = {
    "gambling": "casino poker slots roulette blackjack baccarat jackpot betting bets bookmaker sportsbook lottery "
                "bingo gamble wager bovada betway pokies craps",
    "adult": "porn xxx sex adult escort camgirl nude hentai milf xvideos pornhub onlyfans erotic fetish hookup "
             "strip nsfw",
    "pills": "viagra cialis pills pharma meds steroids weightloss slimming xanax tramadol drugs dietpill painkiller "
             "fatburn",
    "money": "payday loans cash forex crypto debt getrich income bitcoin quickmoney profit earn",
    "piracy": "warez torrent crack keygen nulled hacks cheats pirate serials unlocker",
    "copies": "replica fake knockoff cheap discount outlet",
    "spam": "spam linkfarm backlinks traffic clicks ads adserver tracker popup affiliate contentfarm bulkmail",
    "fraud": "phish verify malware virus trojan prize winner giveaway reward claim freegift lucky"}
ALLOWED_WORDS = (
    "news weather library museum school university science history cooking garden travel music nature health "
    "council data herald times review physics chemistry maths linux python archive gallery farmers football railway "
    "hospital parliament tierheim stadtwerke bibliothek universidad biblioteca noticias musee journal recettes "
    "mairie nation motion thousand another together north south month truth mother thread theatre theory gathering "
    "wealth strength breath ancient attention station edition tradition relation creation foundation education "
    "reading writing walking sailing heritage orchard harvest forest ensemble whale shore river mountain lake "
    "street village family children people country water animal flower bridge castle church island ocean").split()
# Others whose letters are like those of blocked words.
LIKE_BLOCKED = (
    "essex sussex sextant classic popcorn cocktail resort escarpment cracker spanish better alphabet bethlehem "
    "betony roads beads address adsorption plots spoke joker cashew cashmere dietitian pharaoh farmhouse pharmacology "
    "medal median steroid-research incoming profile earth torrential virtual cheese chapel replicate outletters "
    "discover traffic-police track-field winter window wind claimants viral credit-union loanword debate forum "
    "fortune winery adulthood striped nursery lotus").split()
FILLERS = "online club world hub city my the top group center info zone house land today live site portal".split()
# Syllables of made-up words: allowed hosts of no subject, so that letters which tell nothing don't block.
SYLLABLES = ("ba ber bi bo bra car cel ci con da del di dor en er el fa fi ga ger go ha hel il in ka ki la le lo ma me "
             "mi mo na ne ni nor pa pe po qua ra re ri ro sa se sil so sta ta te ti tu tra ul un va ve vi vo wa we wi "
             "ya za").split()
MADE_UP = 600
PREFIXES = ("", "www.", "blog.", "m.")
ENDINGS = ("example.com/en/{}", "org/de/{}.html", "example.net/fr/{}?page=2", "com/{}/", "net/{}", "co.uk/a/{}",
           "example.org/{}.php?id=1")


def made_up(i: int) -> str:
    """The ``i``-th made-up word, of two or three syllables."""
    n = len(SYLLABLES)
    return "".join(SYLLABLES[(step * i + i // n) % n] for step in (1, 7, 31)[: 2 + i % 2])


def hosts_of(word: str, i: int) -> list[str]:
    """Eight hosts of the ``i``-th word: alone, numbered, as a plural, and beside fillers and a made-up word."""
    a, b, c = (FILLERS[(step * i + step) % len(FILLERS)] for step in (1, 5, 7))
    return [word, f"{word}{7 * i % 90 + 10}", f"{word}s", f"{word}-{a}", f"{b}{word}", f"{word}{c}", f"{c}-{word}-{a}",
            f"{made_up(i)}{word}"]


def labelled_urls(spark: SparkSession, without: str | None = None) -> DataFrame:
    """The default labelled table (url, blocked): eight hosts a word, and the made-up words; prefixes and endings in turn.

    The blocked words of the subject ``without`` are left out, to hold it out.
    """
    blocked = [w for subject, words in BLOCKED_WORDS.items() if subject != without for w in words.split()]
    rows = [(f"https://{PREFIXES[i % len(PREFIXES)]}{made_up(i)}.{ENDINGS[i % len(ENDINGS)].replace('{}', str(i))}", 0)
            for i in range(MADE_UP)]
    for label, words in ((1, blocked), (0, ALLOWED_WORDS + LIKE_BLOCKED)):
        for i, word in enumerate(words):
            for j, host in enumerate(hosts_of(word, i)):
                ending = ENDINGS[(i + 2 * j) % len(ENDINGS)].replace("{}", str(1000 + 37 * i))
                rows.append((f"https://{PREFIXES[(i + j) % len(PREFIXES)]}{host}.{ending}", label))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in rows) + " AS t(url, blocked)")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule that fits host (or a parent domain) and path start, else null.

    The rules are a literal list and become one CASE, longest first.
    """
    rule, allowed = None, None
    for allow, own_host, own_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        rule = F.when(fits, own_host + own_path) if rule is None else rule.when(fits, own_host + own_path)
        allowed = F.when(fits, F.lit(allow)) if allowed is None else allowed.when(fits, F.lit(allow))
    none = F.lit(None)
    return (none.cast("string"), none.cast("boolean")) if rule is None else (rule, allowed)


def ngram_buckets(host: Column, path: Column) -> Column:
    """array<int> of the buckets of all n-grams; those of host and path are hashed apart."""

    def grams(part: Column, name: str, n: int) -> Column:
        def of(bounded: Column) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(bounded) - (n - 1)))
            return F.transform(places, lambda at: F.pmod(
                F.xxhash64(F.lit(f"{name}{n}"), F.substr(bounded, at, F.lit(n))), F.lit(DIMS)).cast("int"))

        return once(F.concat(F.lit("^"), part, F.lit("$")), of)

    # Digits are alike: numbers of pages say nothing about them.
    flat = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*(grams(host, "host", n) for n in NGRAMS), *(grams(flat, "path", n) for n in NGRAMS))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> tuple[list[float], float]:
    """(coefficients, intercept) fitted on at most MAX_LABELLED rows with a url and a label.

    A table without both labels gives zeros and the sure answer.
    """
    rows = (labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
            .orderBy(F.xxhash64(url_col), url_col).limit(MAX_LABELLED)
            .select(F.col(label_col).cast("double").alias("label"),
                    ngram_buckets(host_of(F.col(url_col)), path_of(F.col(url_col))).alias("grams")))
    # Every bucket is a word of a fixed vocabulary: sparse 0-1 vectors.
    sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(DIMS)], "grams", "features")
    rows = sparse.setBinary(True).transform(rows.withColumn("grams", F.col("grams").cast("array<string>")))
    labels = {r[0] for r in rows.select("label").distinct().collect()}
    if len(labels) < 2:
        return [0.0] * DIMS, (50.0 if labels == {1.0} else -50.0)
    model = LogisticRegression(regParam=REGULARIZATION, maxIter=60, tol=1e-5, standardization=False).fit(
        rows.coalesce(1))  # at most MAX_LABELLED rows
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def probability(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """Probability that a URL is to be blocked."""
    # One literal, folded by the optimizer: far less than a column a coefficient.
    weights = F.split(F.lit(",".join(map(repr, model[0]))), ",").cast("array<double>")
    grams = F.array_distinct(ngram_buckets(host, path))
    total = F.aggregate(grams, F.lit(model[1]), lambda s, g: s + F.get(weights, g))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, labelled: DataFrame | None = None, url_col: str = "url",
          rules=RULES) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, score (probability of blocking) and verdict.

    The verdict is the longest fitting rule's, else the classifier's.  A null
    url, or one without "://", has an empty host and path and the classifier's
    verdict.  The columns replace columns of the same names, in upper or lower
    case; repeated rows are judged alike; no rows give no rows.
    """
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    own = unused(pages.columns, "_host", "_path", "_score")
    out = pages.withColumns({own[0]: host_of(F.col(url_col)), own[1]: path_of(F.col(url_col))})
    host, path, chance = (F.col(c) for c in own)
    rule, allowed = rule_of(host, path, rules)
    score = probability(host, path, model)
    out = out.withColumn(own[2], score)
    verdict = F.when(F.coalesce(allowed, chance < THRESHOLD), "allow").otherwise("block")
    return out.withColumns({"host": host, "path": path, "rule": rule, "score": chance,
                            "verdict": verdict}).drop(*own)
