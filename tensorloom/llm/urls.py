"""URL filter: host rules first, else a logistic regression on hashed character n-grams of host and path.

Everything that touches rows is a DataFrame expression. The regression is fitted on the driver from
``LABELLED``, a table of a few dozen labelled URLs that ships with the operator (its size is the bound),
and reaches the plan as an array of ``BUCKETS`` whole-numbered weights.

Defined results: a null url or one without ``://`` has an empty host and path, matches no rule and is
judged by the model on the empty string; hosts lower-case A-Z only; ports and user names belong to the
host as written; an empty path doesn't start with ``/``; of rules of equal length the smallest by host and path
holds; repeated rows give repeated results, an empty table an empty one; other columns of ``judged`` stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Weights and bias are whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1000

#: (host, path, verdict), as contract of the query: a rule holds for its host and all subdomains.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_ALLOWED = """news.site.org/en/article/12 docs.site.org/guide/intro en.library.org/book/77 www.university.edu/research/paper/3
blog.writer.org/2020/01/post www.museum.org/collection/item/9 wiki.project.org/wiki/page forum.science.org/thread/88
m.paper.net/en/25 www.paper.net/de/story/4 archive.texts.org/de/825 kids.learning.org/lesson/5 health.agency.gov/topic/flu
open.data.gov/dataset/11 code.project.org/repo/readme city.council.gov/minutes/2019 press.office.org/en/release/7
journal.history.org/vol/3 recipes.kitchen.org/soup/21 www.weather.org/forecast/north poems.archive.org/es/19 law.court.gov/case/45
www.encyclopedia.org/entry/tree magazine.culture.org/fr/essay/2 maths.school.edu/algebra/1 read.stories.net/en/tale/8
radio.public.org/show/6 support.maker.org/manual/14 farm.extension.edu/crops/wheat blog.travel.org/alps""".split()
_BLOCKED = """casino.bonus-win.biz/play?ref=1 cheap-pills.shop.biz/buy/now xxx.adult-cams.info/live/1 free-download.warez.info/crack/99
ads.tracker.biz/click/redirect win-prize.lottery.biz/claim hot-singles.dating.info/join poker.slots-jackpot.biz/spin
replica-watches.store.biz/sale cracked-keygen.warez.biz/serial viagra-online.pharm.biz/order bet.casino-royal.info/odds
sex.videos-xxx.biz/watch/3 spam.mail-list.biz/unsubscribe track.ad-server.info/pixel.gif porn.tube-free.info/clip/55
loan-payday.cash.biz/apply torrent.pirate-dl.info/get/8 click.popup-ads.biz/go?x=2 cheap-seo.links.biz/buy-links
login.verify-account.info/secure phish.bank-update.biz/login nude.cams-live.biz/room/2 jackpot.slots.info/free-spins
coupon.deal-spam.biz/redeem malware.exe-host.info/setup.exe keygen.serial-crack.info/full adult.escort-list.biz/city
bitcoin-double.invest.biz/earn miracle-diet.pills.info/order""".split()
LABELLED = [(x, 0) for x in _ALLOWED] + [(x, 1) for x in _BLOCKED]


def _buckets(text: str) -> list[int]:
    framed = [ord(c) for c in f"^{text}$"]
    return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(framed, framed[1:], framed[2:])]


def fitted(labelled: list[tuple[str, int]] = LABELLED, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[list[int], int]:
    """Weights by bucket and bias of the logistic regression, as multiples of 1 / SCALE; a positive sum says block."""
    weights, bias = [0.0] * BUCKETS, 0.0
    rows = [(_buckets(text), label) for text, label in labelled]
    for _ in range(rounds):
        for grams, label in rows:
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[g] for g in grams))))) - label
            bias -= rate * error
            for g in grams:
                weights[g] -= rate * (error + decay * weights[g])
    return [round(w * SCALE) for w in weights], round(bias * SCALE)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def margin(text: Column, weights: list[int], bias: int) -> Column:
    """The model's sum for a text, in multiples of 1 / SCALE."""
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    table = F.lit(weights)

    def summed(code: Column) -> Column:
        def weight(i: Column) -> Column:
            gram = F.element_at(code, i) * 961 + F.element_at(code, i + 1) * 31 + F.element_at(code, i + 2)
            return F.element_at(table, (gram % BUCKETS + 1).cast("int")).cast("long")

        last = F.size(code) - 2
        first = F.lit(bias).cast("long")
        return F.when(last >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), first, lambda total, i: total + weight(i))).otherwise(first)

    # the codes become a lambda's variable, so that they are computed once a row
    return F.element_at(F.transform(F.array(codes), summed), 1)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: tuple[list[int], int] | None = None, url: str = "url") -> DataFrame:
    """Adds url_host, url_path, url_rule (the longest that fits), url_verdict and url_margin to each row.

    ``rules`` become one CASE expression, longest first: meant for up to a few hundred of them.
    """
    weights, bias = model or fitted()
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("url_host", host).withColumn("url_path", path)
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((F.col("url_host") == h) | F.col("url_host").endswith(f".{h}")) & F.col("url_path").startswith(p) for h, p, _ in longest]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, longest)], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, longest)], F.when(F.col("url_margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    out = out.withColumn("url_margin", margin(F.concat("url_host", "url_path"), weights, bias))
    return out.withColumn("url_rule", rule).withColumn("url_verdict", said)


def query(spark, sf_dir: str) -> DataFrame:
    from tensorloom.llm.common import table

    out = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_margin").alias("margin"))


def oracle() -> str:
    weights, bias = fitted()
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fit = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in longest]
    return f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
scored AS (SELECT *, '^' || host || path || '$' AS framed FROM parts),
summed AS (SELECT page_id, host, path, CAST({bias} + coalesce(list_sum(list_transform(range(1, length(framed) - 1),
  lambda i: CAST({weights}[(unicode(substr(framed, i, 1)) * 961 + unicode(substr(framed, i + 1, 1)) * 31 + unicode(substr(framed, i + 2, 1))) % {BUCKETS} + 1] AS BIGINT))), 0) AS BIGINT) AS margin FROM scored)
SELECT page_id, host, path, CASE {' '.join(f"{f} THEN '{h}{p}'" for f, (h, p, _) in zip(fit, longest))} END AS rule,
  CASE {' '.join(f"{f} THEN '{v}'" for f, (_, _, v) in zip(fit, longest))} WHEN margin > 0 THEN 'block' ELSE 'allow' END AS verdict, margin FROM summed"""
