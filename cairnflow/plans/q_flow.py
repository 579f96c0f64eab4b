"""Queries of the ingest, flatten, heuristic and entity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.durable import stash
from cairnflow.functions import scalars as S
from cairnflow.operators import chains, components, entities, flatten, heuristics, ingest
from cairnflow.plans import projections as P
from cairnflow.plans.registry import query

W = "WITH " + P.PAYMENTS
WP = "WITH " + P.POOLED
LIFE = """,
life AS (SELECT coalesce(r.addr, s.addr) AS addr, coalesce(rt, -1) AS first_recv_tx, coalesce(st, -1) AS first_spend_tx, least(coalesce(rt, st), coalesce(st, rt)) AS first_seen_tx,
  coalesce(tx.ts, -1) AS first_recv_ts
  FROM (SELECT addr, min(tx_idx) AS rt FROM outputs GROUP BY 1) r FULL JOIN (SELECT addr, min(tx_idx) AS st FROM inputs GROUP BY 1) s ON r.addr = s.addr LEFT JOIN tx ON tx.tx_idx = rt)"""
CHANGE = """,
sides AS (SELECT o.tx_idx, pos, o.addr, CAST(round(amount * 100) AS BIGINT) AS u, first_seen_tx = o.tx_idx AS is_new, CAST(round(amount * 100) AS BIGINT) % 100 = 0 AS is_round
  FROM outputs o JOIN tx ON tx.tx_idx = o.tx_idx AND n_out = 2 JOIN life ON life.addr = o.addr),
pair AS (SELECT p.tx_idx, p.addr AS pa, q.addr AS qa, p.is_round AS pr, q.is_round AS qr,
  CASE WHEN p.is_new AND NOT q.is_new THEN 0.5 ELSE 0 END + CASE WHEN NOT p.is_round AND q.is_round THEN 0.3 ELSE 0 END + CASE WHEN p.is_new AND NOT p.is_round AND q.is_new AND q.is_round THEN 0.15 ELSE 0 END
   + CASE WHEN p.is_new AND NOT p.is_round THEN 0.15 ELSE 0 END + CASE WHEN p.u >= 4 * q.u THEN 0.45 ELSE 0 END AS sp,
  CASE WHEN q.is_new AND NOT p.is_new THEN 0.5 ELSE 0 END + CASE WHEN NOT q.is_round AND p.is_round THEN 0.3 ELSE 0 END + CASE WHEN q.is_new AND NOT q.is_round AND p.is_new AND p.is_round THEN 0.15 ELSE 0 END
   + CASE WHEN q.is_new AND NOT q.is_round THEN 0.15 ELSE 0 END + CASE WHEN q.u >= 4 * p.u THEN 0.45 ELSE 0 END AS sq
  FROM sides p JOIN sides q ON p.tx_idx = q.tx_idx AND p.pos = 0 AND q.pos = 1),
chg AS (SELECT tx_idx, CAST(greatest(0, least(0.95, greatest(sp, sq) - 0.5 * least(sp, sq))) AS DOUBLE) AS confidence,
  CASE WHEN greatest(0, least(0.95, greatest(sp, sq) - 0.5 * least(sp, sq))) >= 0.5 THEN CASE WHEN sp >= sq THEN pa ELSE qa END END AS change_addr,
  CASE WHEN sp >= sq THEN qr ELSE pr END AS round_payment FROM pair)"""
PEEL = """,
nxt AS (SELECT c.tx_idx, first_spend_tx AS next FROM chg c JOIN life ON addr = change_addr JOIN tx a ON a.tx_idx = c.tx_idx JOIN tx b ON b.tx_idx = first_spend_tx
  WHERE first_spend_tx > c.tx_idx AND b.ts - a.ts <= 34560000),
valid AS (SELECT tx_idx FROM tx WHERE (tx_idx IN (SELECT tx_idx FROM chg WHERE change_addr IS NOT NULL) OR (n_out = 2 AND tx_idx IN (SELECT next FROM nxt))) AND n_in <= 2),
peel AS (SELECT tx_idx, next FROM nxt WHERE tx_idx IN (FROM valid) AND next IN (FROM valid))"""
HOPS = """,
slow AS (SELECT i.tx_idx, count(*) FILTER (WHERE tx.ts - first_recv_ts > 5184000) AS n FROM inputs i JOIN life USING (addr) JOIN tx ON tx.tx_idx = i.tx_idx GROUP BY 1),
hop AS (SELECT tx.tx_idx FROM tx JOIN slow ON slow.tx_idx = tx.tx_idx WHERE n_out = 1 AND n = 0),
layer AS (SELECT h.tx_idx, first_spend_tx AS next FROM hop h JOIN outputs o ON o.tx_idx = h.tx_idx JOIN life ON life.addr = o.addr WHERE first_spend_tx > h.tx_idx AND first_spend_tx IN (FROM hop))"""
CHAIN = """,
fwd AS (SELECT tx_idx AS start, tx_idx AS node, 0 AS pos FROM {links} WHERE tx_idx NOT IN (SELECT next FROM {links}) UNION ALL SELECT start, l.next, pos + 1 FROM fwd JOIN {links} l ON l.tx_idx = node),
good AS (SELECT start, max(pos) + 1 AS length FROM fwd GROUP BY 1 HAVING max(pos) + 1 >= {least}),
own AS (SELECT node AS tx_idx, max_by(struct_pack(start := fwd.start, pos := pos, length := length), fwd.start) AS x FROM fwd JOIN good ON good.start = fwd.start GROUP BY 1)
SELECT tx_idx, x.start AS start, CAST(x.pos AS BIGINT) AS pos, CAST(x.length AS BIGINT) AS length FROM own"""
#: Entities of the payments: customer nation and address form clusters of a fixed size.
MEMBER = """,
member AS (SELECT addr, addr % 500 AS entity FROM (SELECT addr FROM inputs UNION SELECT addr FROM outputs)),
sent AS (SELECT entity, tx_idx, sum(amount) AS amount FROM inputs JOIN member USING (addr) GROUP BY 1, 2),
ext AS (SELECT o.*, m.entity FROM outputs o JOIN member m USING (addr) WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.entity = m.entity AND s.tx_idx = o.tx_idx)),
recv AS (SELECT entity, tx_idx, sum(amount) AS amount FROM ext GROUP BY 1, 2),
flow AS (SELECT s.entity AS src, e.entity AS dst, e.amount, tx.ts, e.tx_idx FROM ext e JOIN inputs i ON i.tx_idx = e.tx_idx JOIN member s ON s.addr = i.addr JOIN tx ON tx.tx_idx = e.tx_idx WHERE s.entity <> e.entity)"""
EVENTS = """,
ev AS (SELECT entity, tx_idx, ts FROM (SELECT entity, tx_idx FROM sent UNION SELECT entity, tx_idx FROM recv) JOIN tx USING (tx_idx))"""


class Book:
    """Payments of one session and folder, with the relations derived from them."""

    def __init__(self, spark, sf_dir, pooled: bool = False):
        self.c = P.POOLS if pooled else P.PRICES
        p = (P.pooled if pooled else P.payments)(spark, sf_dir)
        self.tx, self.inputs, self.outputs = p.tx, p.inputs, p.outputs
        self.pool = heuristics.pools(self.tx, self.inputs, self.outputs, self.c)

    @property
    def life(self):
        return heuristics.lifecycle(self.tx, self.inputs, self.outputs)

    @property
    def changes(self):
        return heuristics.change(self.tx, self.outputs, self.life, self.pool, self.c)

    _member = None

    def written(self) -> Book:
        """This book with its relations written once, for plans that meet them several times."""
        for name in ("tx", "inputs", "outputs"):
            setattr(self, name, stash(getattr(self, name), name))
        self.pool = stash(heuristics.pools(self.tx, self.inputs, self.outputs, self.c), "pool")
        self._member = stash(self.member, "member")
        return self

    @property
    def member(self):
        if self._member is not None:
            return self._member
        return self.inputs.select("addr").union(self.outputs.select("addr")).distinct().withColumn("entity", F.col("addr") % 500)

    @property
    def sent(self):
        return entities.sent(self.inputs, self.member)

    @property
    def external(self):
        return entities.external_outputs(self.outputs, self.member, self.sent)

    @property
    def recv(self):
        return entities.received(self.external)

    @property
    def flow(self):
        return entities.flows(self.tx, self.inputs, self.outputs, self.member, self.pool, self.external)

    @property
    def events(self):
        return entities.events_of(self.sent, self.recv, self.tx)


def r(df, digits: int, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def nudged(df, digits: int, *cols):
    """Rounded after a nudge: means of cents often lie on ties, which engines round either way."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, digits) for c in cols})


@query("n01_first_obs", "WITH " + P.TELEMETRY + " SELECT entity, min_by(obs, ts) AS obs, min(ts) AS ts FROM obs GROUP BY 1")
def n01(spark, d):
    return flatten.first_observations(P.telemetry(spark, d), "entity", "ts", "obs").select("entity", "obs", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("n02_tx_index", W + " SELECT tx_idx, txid, ts, CAST(n_in AS BIGINT) AS n_in, n_out FROM tx")
def n02(spark, d):
    return P.payments(spark, d).tx


@query("n03_flatten", W + " SELECT tx_idx, pos, addr, amount FROM outputs")
def n03(spark, d):
    nested = flatten.nest_sides(P.payments(spark, d).outputs, "tx_idx", "addrs", "amounts")
    return flatten.explode_sides(nested, "tx_idx", "addrs", "amounts").withColumn("pos", F.col("pos").cast("bigint"))


@query("s16_nest", W + " SELECT tx_idx, string_agg(CAST(addr AS VARCHAR), '|' ORDER BY pos) AS addrs, count(*) AS n FROM outputs GROUP BY 1")
def s16(spark, d):
    nested = flatten.nest_sides(P.payments(spark, d).outputs, "tx_idx", "addrs", "amounts")
    return nested.select("tx_idx", F.array_join(F.transform("addrs", lambda x: x.cast("string")), "|").alias("addrs"), F.size("amounts").cast("bigint").alias("n"))


@query("n04_factorise", W + " SELECT addr, dense_rank() OVER (ORDER BY addr) - 1 AS code FROM (SELECT addr FROM inputs UNION SELECT addr FROM outputs)")
def n04(spark, d):
    b = Book(spark, d)
    return flatten.dense_index(b.member.select("addr"), "code", F.floor(F.col("addr") / 1000), ["addr"])


@query("n05_tx_sums", W + """ SELECT tx_idx, round(total_in, 2) AS total_in, round(total_out, 2) AS total_out, round(greatest(total_in - total_out, 0), 2) AS fee
 FROM (SELECT tx_idx, sum(amount) AS total_in FROM inputs GROUP BY 1) JOIN (SELECT tx_idx, sum(amount) AS total_out FROM outputs GROUP BY 1) USING (tx_idx)""")
def n05(spark, d):
    b = Book(spark, d)
    i = b.inputs.groupBy("tx_idx").agg(F.sum("amount").alias("total_in"), F.count(F.lit(1)).alias("n"))
    o = b.outputs.groupBy("tx_idx").agg(F.sum("amount").alias("total_out"))
    fee = flatten.derive_fee(F.lit(None).cast("double"), F.col("n"), F.col("total_in"), F.col("total_out"))
    return i.join(o, "tx_idx").select("tx_idx", F.round("total_in", 2).alias("total_in"), F.round("total_out", 2).alias("total_out"), F.round(fee, 2).alias("fee"))


@query("n06_summary", W + " SELECT (SELECT count(*) FROM tx) AS n_tx, (SELECT count(*) FROM inputs) AS n_inputs, (SELECT count(*) FROM outputs) AS n_outputs, (SELECT min(ts) FROM tx) AS first_ts, (SELECT max(ts) FROM tx) AS last_ts")
def n06(spark, d):
    b = Book(spark, d)
    sums = b.tx.agg(F.count(F.lit(1)).alias("n_tx"), F.sum("n_in").alias("n_inputs"), F.sum("n_out").alias("n_outputs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return sums


@query("n07_fingerprint", """WITH h AS (SELECT CAST(o_orderdate AS DATE) AS bucket, CAST('0x' || substring(md5(o_orderkey || '|' || CAST(round(o_totalprice * 100) AS BIGINT)), 1, 12) AS BIGINT) AS x FROM orders)
 SELECT bucket, count(*) AS n, sha256(count(*) || ':' || CAST(sum(x) AS HUGEINT)) AS digest FROM h GROUP BY 1""")
def n07(spark, d):
    return flatten.fingerprint(P.table(spark, d, "orders"), F.col("o_orderdate").cast("date"), F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint"))


RAW = """raw AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'junk' ELSE 'ok' END AS ts, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'x' END AS txid,
 o_orderkey % 11 = 0 AS bad_list, o_orderkey % 7 = 0 AS bad_length, o_orderkey % 5 = 0 AS none, o_orderkey % 3 = 0 AS negative FROM orders)"""


@query("p07_drop_reasons", "WITH " + RAW + """ SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ts = 'junk' THEN 'unparseable_timestamp' WHEN txid = '' THEN 'missing_txid'
 WHEN bad_list THEN 'malformed_list_cell' WHEN bad_length THEN 'address_amount_length_mismatch' WHEN none THEN 'no_outputs' WHEN negative THEN 'negative_amount' ELSE 'kept' END AS reason FROM raw) GROUP BY 1""")
def p07(spark, d):
    k = F.col("o_orderkey")
    raw = P.table(spark, d, "orders").select(
        F.when(k % 17 == 0, "junk").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.when(k % 13 == 0, "").otherwise(k.cast("string")).alias("txid"),
        F.lit('["a","b"]').alias("input_addresses"), F.lit("1|2").alias("input_amounts"),
        F.when(k % 5 == 0, "").when(k % 11 == 0, F.lit('["c"')).otherwise("c,d").alias("output_addresses"),
        F.when(k % 11 == 0, "[1.5, x").when(k % 7 == 0, "1;2;3").when(k % 5 == 0, "").when(k % 3 == 0, "-1 2").otherwise("[1, 0.5]").alias("output_amounts"),
    )
    return ingest.drop_reasons(ingest.parse_rows(raw))


@query("p06_list_cells", "WITH " + P.LINES + " SELECT l_orderkey AS k, pos, l_partkey AS item FROM lines")
def p06(spark, d):
    lines = P._lines(spark, d)
    rows = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("items"))
    k = F.col("l_orderkey")
    cell = F.when(k % 4 == 0, F.to_json("items")).when(k % 4 == 1, F.array_join("items", "|")).when(k % 4 == 2, F.array_join("items", "; ")).otherwise(F.array_join("items", ","))
    return rows.select(k.alias("k"), F.posexplode(S.parse_list(cell)).alias("pos", "item")).select("k", F.col("pos").cast("bigint").alias("pos"), F.col("item").cast("bigint").alias("item"))


@query("p04_parse_times", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def p04(spark, d):
    k, t = F.col("event_id"), F.col("ts").cast("timestamp")
    text = F.when(k % 4 == 0, t.cast("long").cast("string")).when(k % 4 == 1, (t.cast("long") * 1000).cast("string")).when(k % 4 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "dd/MM/yyyy HH:mm:ss"))
    return P.table(spark, d, "events").select(k.alias("event_id"), F.floor(S.parse_time(text)).alias("seconds"))


@query("p08_unit", """SELECT median(o_totalprice) AS typical, median(o_totalprice) > 1e6 AS small_units FROM (SELECT o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_orderkey LIMIT 5000)""")
def p08(spark, d):
    rows = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.array("o_totalprice").alias("output_amounts"))
    return ingest.detect_unit(rows, "row")


@query("p14_validate", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_orderkey IS NULL) AS null_keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS repeated_keys,
 count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS outside_set, count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.05) AS outside_range,
 (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS dangling FROM lineitem""")
def p14(spark, d):
    return ingest.validate(P.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_returnflag": ["A", "N"]}, {"l_discount": (0, 0.05)}, P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@query("p21_median_impute", """SELECT c_custkey, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x, c_custkey FROM customer) WHERE c_custkey % 2 = 0)) AS x
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x FROM customer)""")
def p21(spark, d):
    rows = P.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    return ingest.impute_medians(rows, rows.where("c_custkey % 2 = 0"), ["x"])


@query("h01_lifecycle", W + LIFE + " SELECT * FROM life")
def h01(spark, d):
    return Book(spark, d).life


@query("h02_equal_outputs", WP + """ SELECT tx.tx_idx, equal, n_in_addr, equal >= 2 AND n_in_addr >= 2 AND equal / n_out >= 0.35 AS is_pool FROM tx
 JOIN (SELECT tx_idx, max(k) AS equal FROM (SELECT tx_idx, amount, count(*) AS k FROM outputs GROUP BY 1, 2) GROUP BY 1) e ON e.tx_idx = tx.tx_idx
 JOIN (SELECT tx_idx, count(DISTINCT addr) AS n_in_addr FROM inputs GROUP BY 1) a ON a.tx_idx = tx.tx_idx""")
def h02(spark, d):
    return Book(spark, d, pooled=True).pool


@query("h03_dust", WP + """ SELECT tx_idx, dust_outputs, dust_outputs >= 2 AND dust_outputs >= 0.5 * n_out AS is_dust FROM tx JOIN (SELECT tx_idx, count(*) FILTER (WHERE amount <= 10) AS dust_outputs FROM outputs GROUP BY 1) USING (tx_idx)""")
def h03(spark, d):
    b = Book(spark, d, pooled=True)
    return heuristics.dust(b.tx, b.outputs, b.c)


@query("h04_change", W + LIFE + CHANGE + " SELECT tx_idx, change_addr, round(confidence, 4) AS confidence, round_payment FROM chg")
def h04(spark, d):
    return r(Book(spark, d).changes, 4, "confidence")


@query("h05_round_payment", W + LIFE + CHANGE + " SELECT round_payment, count(*) AS n FROM chg GROUP BY 1")
def h05(spark, d):
    return Book(spark, d).changes.groupBy("round_payment").agg(F.count(F.lit(1)).alias("n"))


@query("h06_peel_links", W + LIFE + CHANGE + PEEL + " SELECT * FROM peel")
def h06(spark, d):
    b = Book(spark, d).written()
    life = stash(b.life, "life")
    return heuristics.peel_links(b.tx, life, b.pool, stash(heuristics.change(b.tx, b.outputs, life, b.pool, b.c), "changes"), b.c)


@query("h08_chains", (W + LIFE).replace("WITH ", "WITH RECURSIVE ", 1) + """,
succ AS (SELECT o.tx_idx, min(first_spend_tx) AS next FROM outputs o JOIN life USING (addr) WHERE first_spend_tx > o.tx_idx GROUP BY 1)""" + CHAIN.format(links="succ", least=4))
def h08(spark, d):
    b = Book(spark, d)
    links = heuristics.successors(b.outputs.select("tx_idx", "addr"), b.tx, b.life).groupBy("tx_idx").agg(F.min("next").alias("next"))
    return chains.follow(links, 4)


@query("h09_peel_chains", (W + LIFE + CHANGE + PEEL).replace("WITH ", "WITH RECURSIVE ", 1) + CHAIN.format(links="peel", least=2))
def h09(spark, d):
    return chains.follow(h06(spark, d), P.PRICES.peel_min_length)


@query("h10_rapid_hop", W + LIFE + HOPS + " SELECT tx_idx FROM hop")
def h10(spark, d):
    b = Book(spark, d)
    return heuristics.rapid_hops(b.tx, b.inputs, b.life, b.pool, b.c)


@query("h11_layering", (W + LIFE + HOPS).replace("WITH ", "WITH RECURSIVE ", 1) + CHAIN.format(links="layer", least=2))
def h11(spark, d):
    b = Book(spark, d).written()
    life = stash(b.life, "life")
    hops = stash(heuristics.rapid_hops(b.tx, b.inputs, life, b.pool, b.c), "hops")
    return chains.follow(heuristics.layer_links(hops, b.tx, b.outputs, life), P.PRICES.layer_min_length)


FANS = """,
pool AS (SELECT tx.tx_idx, equal >= 2 AND n_in_addr >= 2 AND equal / n_out >= 0.35 AS is_pool FROM tx JOIN (SELECT tx_idx, max(k) AS equal FROM (SELECT tx_idx, amount, count(*) AS k FROM outputs GROUP BY 1, 2) GROUP BY 1) e USING (tx_idx)
 JOIN (SELECT tx_idx, count(DISTINCT addr) AS n_in_addr FROM inputs GROUP BY 1) a USING (tx_idx)),
dust AS (SELECT tx_idx, d >= 2 AND d >= 0.5 * n_out AS is_dust FROM tx JOIN (SELECT tx_idx, count(*) FILTER (WHERE amount <= 10) AS d FROM outputs GROUP BY 1) USING (tx_idx)),
fan AS (SELECT tx_idx, n_in >= 5 AND n_out <= 2 AND NOT is_pool AS consolidation, n_out >= 5 AND NOT is_pool AND NOT is_dust AS batch_payout FROM tx JOIN pool USING (tx_idx) JOIN dust USING (tx_idx))"""


@query("h12_fans", WP + FANS + " SELECT * FROM fan")
def h12(spark, d):
    b = Book(spark, d, pooled=True)
    return heuristics.fans(b.tx, b.pool, heuristics.dust(b.tx, b.outputs, b.c), b.c)


@query("h14_counts", WP + FANS + " SELECT count(*) FILTER (WHERE is_pool) AS pools, count(*) FILTER (WHERE is_dust) AS dusts, count(*) FILTER (WHERE consolidation) AS consolidations, count(*) FILTER (WHERE batch_payout) AS payouts FROM fan JOIN pool USING (tx_idx) JOIN dust USING (tx_idx)")
def h14(spark, d):
    b = Book(spark, d, pooled=True)
    rows = h12(spark, d).join(b.pool, "tx_idx").join(heuristics.dust(b.tx, b.outputs, b.c), "tx_idx")
    return rows.agg(F.count_if("is_pool").alias("pools"), F.count_if("is_dust").alias("dusts"), F.count_if("consolidation").alias("consolidations"), F.count_if("batch_payout").alias("payouts"))


@query("h15_validation", WP + FANS + """ SELECT n_flagged, n_true, hits, round(hits / n_flagged, 6) AS precision, round(hits / n_true, 6) AS recall FROM
 (SELECT count(*) FILTER (WHERE is_pool) AS n_flagged, count(*) FILTER (WHERE n_out >= 3) AS n_true, count(*) FILTER (WHERE is_pool AND n_out >= 3) AS hits FROM pool JOIN tx USING (tx_idx))""")
def h15(spark, d):
    b = Book(spark, d, pooled=True)
    return r(heuristics.validation(b.pool.where("is_pool").select("tx_idx"), b.tx.where("n_out >= 3").select("tx_idx")), 6, "precision", "recall")


@query("e01_ownership_edges", WP + FANS + """, first AS (SELECT tx_idx, arg_min(addr, pos) AS sender FROM inputs GROUP BY 1)
 SELECT DISTINCT addr AS src, sender AS dst FROM inputs JOIN first USING (tx_idx) JOIN tx USING (tx_idx) JOIN pool USING (tx_idx) WHERE n_in >= 2 AND NOT is_pool""")
def e01(spark, d):
    b = Book(spark, d, pooled=True)
    none = b.tx.where("false").select("tx_idx", F.lit(0).cast("bigint").alias("change_addr"), F.lit(0.0).alias("confidence"))
    return entities.ownership_edges(b.tx, b.inputs, b.pool, none)


CC = """WITH RECURSIVE """ + P.OWNERSHIP + """, both_ways AS (SELECT src, dst FROM own UNION SELECT dst, src FROM own),
reach AS (SELECT src AS node, src AS other FROM both_ways UNION SELECT node, dst FROM reach JOIN both_ways ON other = src), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""


@query("e03_components", CC + " SELECT * FROM comp")
def e03(spark, d):
    return components.connected_components(P.ownership(spark, d))


@query("e04_purity", CC + """, cell AS (SELECT component, node % 5 AS owner, count(*) AS n FROM comp GROUP BY 1, 2), owners AS (SELECT owner, count(*) AS k FROM cell GROUP BY 1 HAVING sum(n) >= 2)
 SELECT round((SELECT sum(t) / sum(s) FROM (SELECT max(n) AS t, sum(n) AS s FROM cell GROUP BY component)), 6) AS purity, round(avg(k), 6) AS clusters_per_entity, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END), 6) AS merged_share FROM owners""")
def e04(spark, d):
    found = e03(spark, d).select(F.col("node").alias("addr"), F.col("component").alias("entity"))
    out = entities.clustering_quality(found, found.select("addr", (F.col("addr") % 5).alias("owner")))
    return r(out, 6, "purity", "clusters_per_entity", "merged_share")


@query("e05_labels", CC + """, t AS (SELECT component AS entity, node % 3 = 0 AS illicit, 's' || (node % 4) AS scenario FROM comp), s AS (SELECT entity, avg(CASE WHEN illicit THEN 1.0 ELSE 0 END) AS share FROM t GROUP BY 1),
 top AS (SELECT entity, arg_min(scenario, (-n, scenario)) AS top FROM (SELECT entity, scenario, count(*) AS n FROM t WHERE illicit GROUP BY 1, 2) GROUP BY 1)
 SELECT s.entity, round(share, 6) AS illicit_share, share >= 0.5 AS is_illicit, CASE WHEN share >= 0.5 THEN top ELSE 'normal' END AS scenario FROM s LEFT JOIN top ON top.entity = s.entity""")
def e05(spark, d):
    found = e03(spark, d).select(F.col("node").alias("addr"), F.col("component").alias("entity"))
    truth = found.select("addr", (F.col("addr") % 3 == 0).alias("illicit"), F.concat(F.lit("s"), F.col("addr") % 4).alias("scenario"))
    return r(entities.labels_from_truth(found, truth), 6, "illicit_share")


@query("e08_sent", W + MEMBER + " SELECT entity, tx_idx, round(amount, 2) AS amount FROM sent")
def e08(spark, d):
    return r(Book(spark, d).sent, 2, "amount")


@query("e09_recv", W + MEMBER + " SELECT entity, tx_idx, round(amount, 2) AS amount FROM recv")
def e09(spark, d):
    return r(Book(spark, d).recv, 2, "amount")


@query("e10_flows", W + MEMBER + " SELECT src, dst, round(amount, 2) AS amount, ts, tx_idx FROM flow")
def e10(spark, d):
    return r(Book(spark, d).written().flow, 2, "amount")


@query("e11_pool_flows", WP + FANS + """, i AS (SELECT DISTINCT tx_idx, addr % 50 AS src FROM inputs JOIN pool USING (tx_idx) WHERE is_pool), o AS (SELECT tx_idx, addr % 50 AS dst, amount FROM outputs JOIN pool USING (tx_idx) WHERE is_pool),
 pr AS (SELECT * FROM i JOIN o USING (tx_idx) WHERE src <> dst), k AS (SELECT tx_idx, count(DISTINCT src) AS k FROM pr GROUP BY 1)
 SELECT tx_idx, src, dst, round(sum(amount / k), 4) AS amount FROM pr JOIN k USING (tx_idx) GROUP BY 1, 2, 3""")
def e11(spark, d):
    b = Book(spark, d, pooled=True)
    member = b.inputs.select("addr").union(b.outputs.select("addr")).distinct().withColumn("entity", F.col("addr") % 50)
    out = entities.flows(b.tx, b.inputs, b.outputs, member, b.pool, entities.external_outputs(b.outputs, member, entities.sent(b.inputs, member)))
    out = out.join(b.pool.where("is_pool"), "tx_idx", "left_semi")
    return out.groupBy("tx_idx", "src", "dst").agg(F.round(F.sum("amount"), 4).alias("amount"))


@query("e12_addresses", W + MEMBER + " SELECT entity, count(*) AS n_addresses FROM member GROUP BY 1")
def e12(spark, d):
    return Book(spark, d).member.groupBy("entity").agg(F.count(F.lit(1)).alias("n_addresses"))


@query("e13_sent_stats", W + MEMBER + """ SELECT entity, count(*) AS n_sent, round(sum(amount), 2) AS total_sent, round(avg(amount) + 1e-7, 4) AS mean_sent, round(coalesce(stddev_samp(amount), 0) + 1e-7, 4) AS std_sent, round(avg(n_out), 6) AS mean_n_out,
 max(n_out) AS max_n_out, avg(n_in) AS mean_n_in, CAST(max(n_in) AS BIGINT) AS max_n_in FROM sent JOIN tx USING (tx_idx) GROUP BY 1""")
def e13(spark, d):
    b = Book(spark, d)
    return r(nudged(r(entities.sent_stats(b.sent, b.tx), 2, "total_sent"), 4, "mean_sent", "std_sent"), 6, "mean_n_out")


@query("e14_recv_stats", W + MEMBER + " SELECT entity, count(*) AS n_recv, round(sum(amount), 2) AS total_recv, round(avg(amount) + 1e-7, 4) AS mean_recv FROM recv GROUP BY 1")
def e14(spark, d):
    return nudged(r(entities.recv_stats(Book(spark, d).recv), 2, "total_recv"), 4, "mean_recv")


@query("e15_pass_through", W + MEMBER + """, s AS (SELECT entity, count(*) AS ns, sum(amount) AS ts FROM sent GROUP BY 1), rr AS (SELECT entity, count(*) AS nr, sum(amount) AS tr FROM recv GROUP BY 1)
 SELECT entity, coalesce(ns, 0) + coalesce(nr, 0) AS n_events, round(CASE WHEN greatest(coalesce(ts, 0), coalesce(tr, 0)) > 0 THEN least(coalesce(ts, 0), coalesce(tr, 0)) / greatest(coalesce(ts, 0), coalesce(tr, 0)) ELSE 0 END, 6) AS pass_through_ratio,
 round(coalesce(nr, 0) / (coalesce(ns, 0) + 1), 6) AS recv_to_sent FROM (SELECT DISTINCT entity FROM member) LEFT JOIN s USING (entity) LEFT JOIN rr USING (entity)""")
def e15(spark, d):
    b = Book(spark, d)
    return r(entities.pass_through(b.member.select("entity").distinct(), entities.sent_stats(b.sent, b.tx), entities.recv_stats(b.recv)), 6, "pass_through_ratio", "recv_to_sent")


@query("e16_degrees", W + MEMBER + """, p AS (SELECT src, dst, sum(amount) AS a, max(amount) AS m FROM flow GROUP BY 1, 2), o AS (SELECT src AS entity, count(*) AS out_degree, sum(a) AS flow_out, max(m) AS max_out FROM p GROUP BY 1), i AS (SELECT dst AS entity, count(*) AS in_degree FROM p GROUP BY 1)
 SELECT entity, coalesce(out_degree, 0) AS out_degree, round(coalesce(flow_out, 0), 2) AS flow_out, coalesce(max_out, 0) AS max_out, coalesce(in_degree, 0) AS in_degree FROM o FULL JOIN i USING (entity)""")
def e16(spark, d):
    return r(entities.degrees(Book(spark, d).written().flow), 2, "flow_out")


@query("e17_amounts", W + MEMBER + " SELECT entity, round(avg(CASE WHEN amount % 1 = 0 THEN 1.0 ELSE 0 END), 6) AS round_share, count(*) FILTER (WHERE amount * 100 <= 500000) AS dust_received FROM ext GROUP BY 1")
def e17(spark, d):
    return Book(spark, d).external.groupBy("entity").agg(F.round(F.avg((F.col("amount") % 1 == 0).cast("double")), 6).alias("round_share"), F.count_if(F.col("amount") * 100 <= 500000).alias("dust_received"))


@query("e19_burstiness", W + MEMBER + EVENTS + """, g AS (SELECT entity, ts, ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, tx_idx) AS gap FROM ev)
 SELECT entity, round((max(ts) - min(ts)) / 3600, 4) AS active_hours, round(CASE WHEN count(gap) >= 3 THEN (stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap) + 1e-9) ELSE 0 END, 6) AS burstiness, coalesce(quantile_cont(gap, 0.5), 0) AS median_gap_s FROM g GROUP BY 1""")
def e19(spark, d):
    return r(r(entities.activity(Book(spark, d).events), 4, "active_hours"), 6, "burstiness")


@query("e20_peak_hour", "WITH " + P.TELEMETRY + ", h AS (SELECT entity, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM obs GROUP BY 1, 2) SELECT entity, max(n) AS peak_events, round(max(n) / sum(n), 6) AS peak_share FROM h GROUP BY 1")
def e20(spark, d):
    rows = P.telemetry(spark, d).select("entity", F.col("ts").cast("double").alias("ts"))
    return r(entities.peak_hour(rows), 6, "peak_share")


@query("e21_dwell", W + LIFE + MEMBER + """, dw AS (SELECT entity, CASE WHEN first_recv_ts >= 0 AND first_recv_tx < i.tx_idx THEN tx.ts - first_recv_ts END AS d FROM inputs i JOIN life USING (addr) JOIN tx ON tx.tx_idx = i.tx_idx JOIN member USING (addr))
 SELECT entity, coalesce(quantile_cont(d, 0.5), -1) AS median_dwell_s, round(avg(CASE WHEN d < 1800 THEN 1.0 ELSE 0 END), 6) AS rapid_spend_share FROM dw GROUP BY 1""")
def e21(spark, d):
    b = Book(spark, d)
    return r(entities.dwell(b.inputs, b.tx, b.life, b.member), 6, "rapid_spend_share")


@query("e22_participation", W + LIFE + CHANGE + MEMBER + " SELECT entity, CAST(sum(CASE WHEN round_payment THEN 1 ELSE 0 END) AS BIGINT) AS rounds, CAST(sum(CASE WHEN change_addr IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS changes FROM sent JOIN chg USING (tx_idx) GROUP BY 1")
def e22(spark, d):
    b = Book(spark, d)
    return entities.participation(b.sent, b.changes.select("tx_idx", F.col("round_payment").alias("rounds"), F.col("change_addr").isNotNull().alias("changes")))


@query("e23_recv_cv", W + MEMBER + " SELECT entity, round(CASE WHEN count(*) >= 8 THEN stddev_samp(amount) / (avg(amount) + 1e-12) ELSE -1 END, 6) AS recv_amount_cv FROM recv GROUP BY 1")
def e23(spark, d):
    return r(entities.receipt_uniformity(Book(spark, d).recv), 6, "recv_amount_cv")


@query("e24_network_shares", "WITH " + P.TELEMETRY + " SELECT entity, count(*) AS n, count(DISTINCT ip) AS n_origin_ips, count(DISTINCT country) AS n_origin_countries FROM obs GROUP BY 1")
def e24(spark, d):
    return entities.network_shares(P.telemetry(spark, d))


@query("e25_wilson", "WITH " + P.TELEMETRY + """, n AS (SELECT entity, ip, count(*) AS k FROM obs GROUP BY 1, 2), t AS (SELECT entity, arg_min(ip, (-k, ip)) AS top_ip, max(k) AS k, sum(k) AS n FROM n GROUP BY 1)
 SELECT entity, top_ip, round(k / n, 6) AS top_ip_share, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM t""")
def e25(spark, d):
    return r(entities.origin_link(P.telemetry(spark, d)), 6, "top_ip_share", "low", "high")


@query("e26_rapid_changes", "WITH " + P.TELEMETRY + ", h AS (SELECT entity, country <> lag(country) OVER w AND epoch(ts) - epoch(lag(ts) OVER w) < 600 AS hop FROM obs WINDOW w AS (PARTITION BY entity ORDER BY ts)) SELECT entity, count(*) FILTER (WHERE hop) AS rapid FROM h GROUP BY 1")
def e26(spark, d):
    return entities.rapid_changes(P.telemetry(spark, d), "country", 600, ["ts", "obs"])


@query("e27_obfuscation", "WITH " + P.SIGNALS + " SELECT entity, round(greatest(0, least(1, 0.6 * coalesce(ml, 0) + 0.4 * coalesce(anomaly, 0) + 0.15 * least(entity % 6, 3) / 3)), 6) AS score FROM sig")
def e27(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return P.signals(spark, d).select("entity", F.round(entities.obfuscation(z("ml"), z("anomaly"), F.col("entity") % 6), 6).alias("score"))


@query("e28_feature_matrix", W + MEMBER + """ SELECT entity, coalesce(n_sent, 0) AS n_sent, coalesce(n_recv, 0) AS n_recv, coalesce(n_addresses, 0) AS n_addresses FROM (SELECT entity, count(*) AS n_addresses FROM member GROUP BY 1)
 LEFT JOIN (SELECT entity, count(*) AS n_sent FROM sent GROUP BY 1) USING (entity) LEFT JOIN (SELECT entity, count(*) AS n_recv FROM recv GROUP BY 1) USING (entity)""")
def e28(spark, d):
    b = Book(spark, d).written()
    out = entities.feature_matrix(b.member.select("entity").distinct(), e12(spark, d), entities.sent_stats(b.sent, b.tx), entities.recv_stats(b.recv))
    return out.select("entity", "n_sent", "n_recv", "n_addresses")
