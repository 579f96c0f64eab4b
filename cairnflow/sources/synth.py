"""Synthetic payments and network observations, drawn from hashes of row numbers: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SynthConfig:
    n_tx: int = 8000
    seed: int = 21
    n_users: int = 1500
    pools_per_1000: int = 10
    dust_per_1000: int = 4
    start: int = 1740787200
    spacing_s: int = 60


def uniform(seed: int, *parts) -> Column:
    """In [0, 1), from a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / (1 << 30)


def payments(spark: SparkSession, c: SynthConfig = SynthConfig()) -> DataFrame:
    """(timestamp, txid, kind, input_addresses, input_amounts, output_addresses, output_amounts, fee): inputs pay outputs and fee.

    kind: plain (payment and change), pool (equal outputs of many payers) or dust (many tiny outputs)."""
    i = F.col("id")
    u = lambda *p: uniform(c.seed, i, *p)
    per = u("kind") * 1000
    kind = F.when(per < c.pools_per_1000, "pool").when(per < c.pools_per_1000 + c.dust_per_1000, "dust").otherwise("plain")
    rows = spark.range(c.n_tx).withColumn("kind", kind)
    n_in = F.when(F.col("kind") == "pool", 5).when(u("n_in") < 0.3, 2).otherwise(1)
    n_out = F.when(F.col("kind") == "pool", 10).when(F.col("kind") == "dust", 21).otherwise(2)
    user = lambda k, what: F.concat(F.lit("u"), F.floor(uniform(c.seed, i, F.lit(what), k) * c.n_users).cast("string"))
    rows = rows.withColumn("fee", F.lit(0.0001)).withColumn("unit", F.round(0.01 + u("amount") * 5, 8))
    each = F.transform(
        F.sequence(F.lit(1), n_out),
        lambda k: F.when(F.col("kind") == "pool", F.when(k <= 5, F.col("unit")).otherwise(F.col("unit") * 0.999)).when(F.col("kind") == "dust", F.when(k <= 20, F.lit(5.46e-6)).otherwise(F.col("unit"))).otherwise(F.when(k == 1, F.col("unit") * 0.3).otherwise(F.col("unit") * 0.7)),
    )
    rows = rows.withColumn("output_amounts", each).withColumn("total", F.aggregate("output_amounts", F.lit(0.0), lambda s, x: s + x) + F.col("fee"))
    rows = rows.withColumn("input_addresses", F.transform(F.sequence(F.lit(1), n_in), lambda k: user(k, "in"))).withColumn("input_amounts", F.transform("input_addresses", lambda x: F.col("total") / F.size("input_addresses")))
    rows = rows.withColumn("output_addresses", F.transform(F.sequence(F.lit(1), n_out), lambda k: F.when((k == 2) & (F.col("kind") == "plain"), F.concat(F.lit("c"), i.cast("string"))).otherwise(user(k, "out"))))
    return rows.select((F.lit(c.start) + i * c.spacing_s).alias("timestamp"), F.sha2(F.concat_ws("-", F.lit(c.seed), i), 256).alias("txid"), "kind", "input_addresses", "input_amounts", "output_addresses", "output_amounts", "fee")


def observations(tx: DataFrame, seed: int = 7, peers: int = 8) -> DataFrame:
    """(tx, obs, ts_ms, src_ip, dst_ip, country, is_synthetic): each transaction spreads over ``peers`` hops with log-uniform delays of
    50 to 400 ms."""
    k, x = F.col("k"), F.col("txid")
    u = lambda what, *p: uniform(seed, x, F.lit(what), *p)
    hop = tx.select("txid", "timestamp", F.explode(F.sequence(F.lit(1), F.lit(peers))).alias("k"))
    delay = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, j: s + 50 * F.pow(F.lit(8.0), uniform(seed, x, F.lit("d"), j)))
    ip = lambda n: F.concat_ws(".", F.lit("11"), *[F.floor(uniform(seed, x, F.lit(w), n) * 256).cast("string") for w in "abc"])
    countries = F.array(*[F.lit(c) for c in ("US", "DE", "NL", "FR", "SG", "JP")])
    return hop.select(
        F.col("txid").alias("tx"), k.alias("obs"), (F.col("timestamp") * 1000 + delay).alias("ts_ms"), ip(k - 1).alias("src_ip"), ip(k).alias("dst_ip"),
        F.element_at(countries, (F.floor(u("country", k) * 6) + 1).cast("int")).alias("country"), F.lit(True).alias("is_synthetic"),
    )


@dataclass(frozen=True)
class ScenarioConfig:
    """A small economy with planted campaigns. ``n_tx`` is a target; campaigns scale with it unless they are given."""

    n_tx: int = 20_000
    days: float = 30.0
    seed: int = 7
    payments_per_user: int = 8
    ransomware: int | None = None
    darknet: int | None = None
    layering: int | None = None
    dust: int | None = None
    start: int = 1735689600
    fee: float = 0.00002


SCENARIOS = ("ransomware", "darknet_market", "layering", "dust_attack")
DUST = 0.00000546


def scenario_payments(spark: SparkSession, c: ScenarioConfig = ScenarioConfig()) -> DataFrame:
    """(timestamp, txid, kind, scenario, campaign, input_addresses, input_amounts, output_addresses, output_amounts, fee).

    Every input spends an output that an earlier row made, whole, and inputs pay outputs and fee; transactions without inputs fund
    wallets. Ordinary users pay each other, merchants and processors (who forward within minutes) from a chain of change; exchanges
    pay out in batches, and private users join pools. Campaigns: victims pay collectors, whose coins are merged and peeled off to an
    exchange (ransomware); many small deposits, batch payouts and vendors who cash out over hops (darknet_market); rapid hops from mule
    to mule (layering); and dust sprayed at users (dust_attack). An address is its owner's name, a dash and a number (``truth``).
    All draws are hashes, so campaigns and users are rows, not steps of one simulation."""
    users = max(60, c.n_tx // (c.payments_per_user + 2))
    exchanges, merchants, processors = max(2, users // 900), max(3, users // 120), max(2, users // 700)
    span, f8 = c.days * 86400, lambda x: F.round(x, 8)
    u = lambda *p: uniform(c.seed, *p)
    name = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    pick = lambda n, *p: F.floor(u(*p) * n)
    cols = ["ts", "kind", "scenario", "campaign", "uid", "input_addresses", "input_amounts", "output_addresses", "output_amounts"]
    arr = lambda *x: F.array(*x)
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<double>")

    def tx(rows: DataFrame, ts: Column, kind: str, uid: Column, ins: Column, iv: Column, outs: Column, ov: Column, scenario: str = "normal", campaign: Column | None = None) -> DataFrame:
        at = F.lit(-1).cast("bigint") if campaign is None else campaign.cast("bigint")
        return rows.select(ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(scenario).alias("scenario"), at.alias("campaign"), uid.alias("uid"), ins.alias("input_addresses"), iv.alias("input_amounts"), outs.alias("output_addresses"), ov.alias("output_amounts")).select(cols)

    def left(start: Column, upto: Column, share) -> Column:
        """What a chain of change holds after ``upto`` payments that take a share each."""
        return F.when(upto < 1, start).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(upto, F.lit(1).cast("bigint"))), start, lambda s, i: f8(s - f8(s * share(i)) - c.fee)))

    def funded(rows: DataFrame, addr: Column, amount: Column, ts: Column, uid: Column, scenario: str = "normal", campaign: Column | None = None) -> DataFrame:
        return tx(rows, ts, "coinbase", uid, none, nothing, arr(addr), arr(amount), scenario, campaign)

    # ordinary users: funding, then a chain of payments with change
    me, k = F.col("id"), F.col("k")
    start = f8(1 + 9 * u("start", me))
    share = lambda i: 0.03 + 0.2 * u("share", me, i)
    own = spark.range(users)
    pay = own.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(c.payments_per_user).cast("bigint"))).alias("k"))
    pay = pay.withColumn("held", left(start, k - 1, share)).withColumn("paid", f8(F.col("held") * share(k))).withColumn("rest", f8(F.col("held") - F.col("paid") - c.fee))
    pay = pay.withColumn("ts", 3600 + (k - 1 + u("when", me, k)) * (span / c.payments_per_user)).withColumn("to", u("to", me, k))
    payee = (
        F.when(F.col("to") < 0.72, name("u", pick(users, "who", me, k), "-r", me, "_", k)).when(F.col("to") < 0.84, name("m", pick(merchants, "who", me, k), "-", pick(3, "till", me, k)))
        .when(F.col("to") < 0.94, name("x", pick(exchanges, "who", me, k), "-d", me)).otherwise(name("p", pick(processors, "who", me, k), "-", me, "_", k))
    )
    pay = pay.withColumn("payee", payee)
    out = funded(own, name("u", me, "-c0"), start, u("open", me) * 3000, name("f", me))
    out = out.unionByName(tx(pay, F.col("ts"), "plain", name("y", me, "_", k), arr(name("u", me, "-c", k - 1)), arr(F.col("held")), arr(F.col("payee"), name("u", me, "-c", k)), arr(F.col("paid"), F.col("rest"))))
    sent_on = pay.where("to >= 0.94 and paid > 0.001")
    out = out.unionByName(tx(sent_on, F.col("ts") + 120 + 1080 * u("soon", me, k), "forward", name("w", me, "_", k), arr(F.col("payee")), arr(F.col("paid")), arr(name("u", pick(users, "then", me, k), "-f", me, "_", k)), arr(f8(F.col("paid") - c.fee))))
    # exchanges: batch payouts from a chain of change
    rounds = max(2, int(c.days))
    ex = spark.range(exchanges).select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(rounds).cast("bigint"))).alias("k")).withColumn("n", 5 + pick(21, "batch", me, k))
    amounts = lambda e, kk: F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(25).cast("bigint")), lambda j: f8(0.01 + 0.05 * u("part", e, kk, j)))
    ex = ex.withColumn("parts", F.slice(amounts(me, k), 1, F.col("n").cast("int"))).withColumn("paid", f8(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)))
    ex = ex.withColumn("before", F.sum(F.col("paid") + c.fee).over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    ex = ex.withColumn("held", f8(F.lit(100.0 + 2.0 * rounds) - F.coalesce("before", F.lit(0.0))))
    out = out.unionByName(funded(spark.range(exchanges), name("x", me, "-h0"), F.lit(100.0 + 2.0 * rounds), F.lit(10.0), name("fx", me)))
    to_users = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda j: name("u", F.floor(u("payout", me, k, j) * users), "-x", me, "_", k, "_", j))
    out = out.unionByName(tx(ex, 3600 + k * (span / rounds), "batch", name("b", me, "_", k), arr(name("x", me, "-h", k - 1)), arr(F.col("held")), F.concat(to_users, arr(name("x", me, "-h", k))), F.concat("parts", arr(f8(F.col("held") - F.col("paid") - c.fee)))))
    # pools: six private users, equal outputs and change
    pools = spark.range(max(2, c.n_tx // 1500)).withColumn("denom", F.element_at(F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1, 0.5)]), (1 + pick(4, "denom", me)).cast("int")))
    six = F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint"))
    member = lambda j: name("u", F.floor(u("private", me, j) * users))
    put = lambda j: f8(F.col("denom") * (1.2 + u("brought", me, j)) + c.fee)
    each = pools.select("id", "denom", F.explode(six).alias("k"))
    out = out.unionByName(funded(each, F.concat(member(k), name("-g", me, "_", k)), put(k), F.lit(20.0), name("fg", me, "_", k)))
    joined = 86400 + u("pool", me) * (span - 86400)
    out = out.unionByName(tx(pools, joined, "pool", name("g", me), F.transform(six, lambda j: F.concat(member(j), name("-g", me, "_", j))), F.transform(six, put), F.concat(F.transform(six, lambda j: F.concat(member(j), name("-e", me, "_", j))), F.transform(six, lambda j: F.concat(member(j), name("-l", me, "_", j)))),
        F.concat(F.transform(six, lambda j: F.col("denom")), F.transform(six, lambda j: f8(put(j) - F.col("denom") - c.fee / 6)))))
    # campaigns
    number = lambda given, per, least: max(least, c.n_tx // per) if given is None else given
    late = span * 0.55
    at = lambda what: 86400 + u(what, me) * (late - 86400)
    deposit = lambda what: name("x", pick(exchanges, what, me), "-", what, me)

    n = number(c.ransomware, 4000, 3)
    r = spark.range(n).withColumn("n", 15 + pick(30, "victims", me)).withColumn("hops", 6 + pick(9, "hops", me))
    ransom = lambda j: f8(F.element_at(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25, 0.5)]), (1 + pick(4, "ransom", me)).cast("int")) * (0.9 + 0.2 * u("asked", me, j)))
    victims = r.select("id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    who = F.concat(name("u", F.floor(u("victim", me, k) * users)), name("-v", me, "_", k))
    had = f8(ransom(k) + 0.3 + c.fee)
    when = at("ransomware") + u("paid", me, k) * 50_000
    out = out.unionByName(funded(victims, who, had, F.lit(30.0), name("fv", me, "_", k), "ransomware", me))
    out = out.unionByName(tx(victims, when, "ransom", name("v", me, "_", k), arr(who), arr(had), arr(name("ro", me, "-", k), F.concat(name("u", F.floor(u("victim", me, k) * users)), name("-w", me, "_", k))), arr(ransom(k), F.lit(0.3)), "ransomware", me))
    to_n = F.sequence(F.lit(1).cast("bigint"), F.col("n"))
    got = F.transform(to_n, ransom)
    total = f8(F.aggregate(got, F.lit(0.0), lambda s, x: s + x) - c.fee)
    merged = at("ransomware") + 60_000
    out = out.unionByName(tx(r, merged, "consolidation", name("rc", me), F.transform(to_n, lambda j: name("ro", me, "-", j)), got, arr(name("ro", me, "-p0")), arr(total), "ransomware", me))
    cut = lambda i: 0.02 + 0.1 * u("peel", me, i)
    peel = r.withColumn("total", total).select("id", "hops", "total", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hops"))).alias("k")).withColumn("held", left(F.col("total"), k - 1, cut)).withColumn("paid", f8(F.col("held") * cut(k)))
    out = out.unionByName(tx(peel, merged + k * 1800, "peel", name("rp", me, "_", k), arr(name("ro", me, "-p", k - 1)), arr(F.col("held")), arr(name("rm", me, "-", k), name("ro", me, "-p", k)), arr(F.col("paid"), f8(F.col("held") - F.col("paid") - c.fee)), "ransomware", me))
    end = r.withColumn("held", left(total, F.col("hops"), cut))
    out = out.unionByName(tx(end, merged + (F.col("hops") + 1) * 1800, "cashout", name("rx", me), arr(name("ro", me, "-p", F.col("hops"))), arr(F.col("held")), arr(deposit("ransom")), arr(f8(F.col("held") - c.fee)), "ransomware", me))

    n = number(c.darknet, 7000, 2)
    m = spark.range(n).withColumn("n", 60 + pick(100, "buys", me)).withColumn("vendors", 3 + pick(4, "vendors", me))
    spent = lambda j: f8(0.005 + 0.03 * u("price", me, j))
    buys = m.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    buyer = F.concat(name("u", F.floor(u("buyer", me, k) * users)), name("-b", me, "_", k))
    had = f8(spent(k) + 0.1 + c.fee)
    opened = at("darknet")
    out = out.unionByName(funded(buys, buyer, had, F.lit(40.0), name("fb", me, "_", k), "darknet_market", me))
    out = out.unionByName(tx(buys, opened + u("bought", me, k) * 6 * 86400, "deposit", name("d", me, "_", k), arr(buyer), arr(had), arr(name("de", me, "-", k), F.concat(name("u", F.floor(u("buyer", me, k) * users)), name("-a", me, "_", k))), arr(spent(k), F.lit(0.1)), "darknet_market", me))
    # the escrow pays out in rounds of twenty deposits
    rounds_ = F.ceil(F.col("n") / 20)
    pays = m.select("id", "n", "vendors", F.explode(F.sequence(F.lit(1).cast("bigint"), rounds_)).alias("k")).withColumn("from", (k - 1) * 20 + 1).withColumn("to", F.least(k * 20, F.col("n")))
    taken = F.transform(F.sequence("from", "to"), spent)
    pays = pays.withColumn("taken", taken).withColumn("worth", f8(F.aggregate("taken", F.lit(0.0), lambda s, x: s + x) - c.fee)).withColumn("each", f8(F.floor(F.col("worth") * 0.9 / F.col("vendors") * 1e8) / 1e8))
    to_v = F.sequence(F.lit(1).cast("bigint"), F.col("vendors"))
    out = out.unionByName(tx(pays, opened + 6.5 * 86400 + k * 40_000, "payout", name("do", me, "_", k), F.transform(F.sequence("from", "to"), lambda j: name("de", me, "-", j)), F.col("taken"), F.concat(F.transform(to_v, lambda j: name("dv", me, "_", j, "-", k)), arr(name("de", me, "-kept", k))),
        F.concat(F.transform(to_v, lambda j: F.col("each")), arr(f8(F.col("worth") - F.col("each") * F.col("vendors")))), "darknet_market", me))
    hop = pays.select("id", "k", "each", F.explode(to_v).alias("v")).select("id", "k", "each", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("h"))
    v, h = F.col("v"), F.col("h")
    hop_in = F.when(h == 1, name("dv", me, "_", v, "-", k)).otherwise(name("dm", me, "_", v, "_", h - 1, "-", k))
    hop_out = F.when(h == 4, F.concat(name("x", pick(exchanges, "dx", me, v), "-dx", me, "_", v))).otherwise(name("dm", me, "_", v, "_", h, "-", k))
    out = out.unionByName(tx(hop, opened + 6.5 * 86400 + k * 40_000 + 25_000 + v * 3000 + h * (60 + 600 * u("hop", me, v, k)), "layer", name("dl", me, "_", k, "_", v, "_", h), arr(hop_in), arr(f8(F.col("each") - (h - 1) * c.fee)), arr(hop_out), arr(f8(F.col("each") - h * c.fee)), "darknet_market", me))

    n = number(c.layering, 2500, 3)
    y = spark.range(n).withColumn("hops", 5 + pick(6, "mules", me)).withColumn("worth", f8(0.5 + 5.5 * u("worth", me)))
    out = out.unionByName(funded(y, name("ls", me, "-0"), F.col("worth"), at("layering") - 10, name("fl", me), "layering", me))
    chain = y.select("id", "hops", "worth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hops"))).alias("k"))
    came = F.when(k == 1, name("ls", me, "-0")).otherwise(name("lm", me, "_", k - 1, "-0"))
    went = F.when(k == F.col("hops"), deposit("layer")).otherwise(name("lm", me, "_", k, "-0"))
    out = out.unionByName(tx(chain, at("layering") + k * (60 + 1000 * u("rest", me)), "layer", name("ll", me, "_", k), arr(came), arr(f8(F.col("worth") - (k - 1) * c.fee)), arr(went), arr(f8(F.col("worth") - k * c.fee)), "layering", me))

    n = number(c.dust, 4000, 2)
    w = spark.range(n).withColumn("n", 1 + pick(4, "sprays", me))
    held = lambda i: f8(F.lit(0.05) - (i - 1) * (40 * DUST + c.fee))
    out = out.unionByName(funded(w, name("da", me, "-0"), F.lit(0.05), at("dust") - 10, name("fd", me), "dust_attack", me))
    spray = w.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    forty = F.sequence(F.lit(1).cast("bigint"), F.lit(40).cast("bigint"))
    out = out.unionByName(tx(spray, at("dust") + k * 1800, "dust", name("ds", me, "_", k), arr(name("da", me, "-", k - 1)), arr(held(k)), F.concat(F.transform(forty, lambda j: name("u", F.floor(u("target", me, k, j) * users), "-c0")), arr(name("da", me, "-", k))), F.concat(F.transform(forty, lambda j: F.lit(DUST)), arr(held(k + 1))), "dust_attack", me))
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    fee = F.when(F.size("input_amounts") == 0, 0.0).otherwise(f8(total_of("input_amounts") - total_of("output_amounts")))
    return out.select((F.lit(c.start) + F.round("ts", 3)).alias("timestamp"), F.sha2(F.concat_ws("-", F.lit(c.seed), "uid"), 256).alias("txid"), "kind", "scenario", "campaign", "input_addresses", "input_amounts", "output_addresses", "output_amounts", fee.alias("fee"))


#: First letters of the owners that belong to each campaign.
OWNERS = {"ro": "ransomware", "rm": "ransomware", "de": "darknet_market", "dv": "darknet_market", "dm": "darknet_market", "ls": "layering", "lm": "layering", "da": "dust_attack"}


def truth(rows: DataFrame) -> DataFrame:
    """(addr, owner, illicit, scenario, campaign) of every address of ``scenario_payments``. Campaigns of different scenarios differ."""
    addr = rows.select(F.explode(F.concat("input_addresses", "output_addresses")).alias("addr")).distinct()
    owner = F.substring_index("addr", "-", 1)
    kind = F.regexp_extract(owner, "^([a-z]+)", 1)
    scenario = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OWNERS.items() for x in kv]), kind), F.lit("normal"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(SCENARIOS) for x in kv[::-1]]), F.col("scenario"))
    number = F.regexp_extract(F.col("owner"), "^[a-z]+([0-9]+)", 1).cast("bigint")
    out = addr.select("addr", owner.alias("owner"), scenario.alias("scenario"))
    return out.select("addr", "owner", (F.col("scenario") != "normal").alias("illicit"), "scenario", F.when(F.col("scenario") != "normal", number * len(SCENARIOS) + order).otherwise(-1).alias("campaign"))


def concentrated(peers: DataFrame, country: str) -> DataFrame:
    """The peers of one country; all of them where there is none."""
    there = peers.where(F.col("country") == country)
    return there if there.take(1) else peers


def demo(spark: SparkSession, n: int = 7) -> DataFrame:
    """A handful of rows to try things on: the first ``n`` of a small scenario economy, by time."""
    return scenario_payments(spark, ScenarioConfig(n_tx=600, ransomware=1, darknet=1, layering=1, dust=1)).orderBy("timestamp", "txid").limit(n)
