"""Library functions, one query for each area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.functions import allocate, datalog, fp, maps, net, regex, sets, std, strings, time, url, uuid, vecs
from rulespark.functions import json as js
from rulespark.queries import Tables, query

c = F.col


@query("SELECT p_partkey AS k, strlen(p_name) AS n, contains(p_name, 'a') AS has, upper(p_name) AS up, lower(p_brand) AS low, reverse(p_brand) AS back, replace(p_name, ' ', '_') AS snake, starts_with(p_type, 'STANDARD') AS std, ends_with(p_type, 'TIN') AS tin, trim(' ' || p_brand || ' ') AS trimmed FROM part")
def q_string_fns(t: Tables) -> DataFrame:
    name, brand, kind = c("p_name"), c("p_brand"), c("p_type")
    return t.part.select(
        c("p_partkey").alias("k"), strings.len(name).cast("long").alias("n"), strings.contains(name, "a").alias("has"), strings.to_uppercase(name).alias("up"), strings.to_lowercase(brand).alias("low"), strings.reverse(brand).alias("back"),
        strings.replace(name, " ", "_").alias("snake"), strings.starts_with(kind, "STANDARD").alias("std"), strings.ends_with(kind, "TIN").alias("tin"), strings.trim(F.concat(F.lit(" "), brand, F.lit(" "))).alias("trimmed"),
    )


@query("SELECT p_partkey AS k, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS x, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n FROM part")
def q_string_split_join(t: Tables) -> DataFrame:
    return t.part.select(c("p_partkey").alias("k"), strings.join(vecs.reverse(strings.split(c("p_name"), " ")), "-").alias("x"), vecs.vec_len(strings.split(c("p_type"), " ")).alias("n"))


@query("SELECT c_custkey AS k, substring(c_name, 3, 4) AS part, array_to_string(list_transform(string_split(c_mktsegment, ''), lambda x: CAST(ascii(x) AS VARCHAR)), ' ') AS bytes FROM customer")
def q_substr_bytes(t: Tables) -> DataFrame:
    return t.customer.select(c("c_custkey").alias("k"), strings.substr(c("c_name"), 2, 6).alias("part"), F.array_join(strings.to_bytes(c("c_mktsegment")).cast("array<string>"), " ").alias("bytes"))


@query("SELECT p_partkey AS k, regexp_matches(p_type, '^[A-Z]+ [A-Z]+ED ') AS ed, regexp_extract(p_brand, '[0-9]+') AS number, array_to_string(regexp_extract_all(p_type, '[A-Z]+'), ',') AS words FROM part")
def q_regex(t: Tables) -> DataFrame:
    kind, brand = c("p_type"), c("p_brand")
    return t.part.select(c("p_partkey").alias("k"), regex.regex_match("^[A-Z]+ [A-Z]+ED ", kind).alias("ed"), regex.regex_first_match("[0-9]+", brand).alias("number"), F.array_join(regex.regex_all_matches("[A-Z]+", kind), ",").alias("words"))


@query("""SELECT k, CAST(list_sum(list_transform(v, lambda x: x * 2)) AS BIGINT) AS doubled, CAST(len(list_filter(v, lambda x: x % 2 = 0)) AS INTEGER) AS even, v[2] AS second, v[10] AS tenth, list_contains(v, 3) AS three, list_max(v) AS most, array_to_string(list_reverse(list_sort(v)), ' ') AS falling
FROM (SELECT p_partkey AS k, [p_size, p_size % 5, p_size % 3] AS v FROM part)""")
def q_vec_fns(t: Tables) -> DataFrame:
    size = c("p_size")
    rows = t.part.select(c("p_partkey").alias("k"), F.array(size, size % 5, size % 3).alias("v"))
    v = c("v")
    return rows.select(
        "k", vecs.fold(vecs.map(v, lambda x: x * 2), F.lit(0), lambda a, x: a + x).cast("long").alias("doubled"), vecs.count(v, lambda x: x % 2 == 0).alias("even"), vecs.nth(v, 1).alias("second"), vecs.nth(v, 9).alias("tenth"),
        vecs.contains(v, 3).alias("three"), vecs.arg_max(v, lambda x: x).alias("most"), F.array_join(vecs.reverse(vecs.sort(v)).cast("array<string>"), " ").alias("falling"),
    )


@query("""SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS u, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: list_contains(b, x))), ' ') AS i, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ' ') AS d, CAST(len(list_distinct(a)) AS INTEGER) AS n
FROM (SELECT p_partkey AS k, [p_size % 4, p_size % 7, 1] AS a, [p_size % 3, p_size % 5, 2] AS b FROM part)""")
def q_set_fns(t: Tables) -> DataFrame:
    size = c("p_size")
    rows = t.part.select(c("p_partkey").alias("k"), vecs.to_set(F.array(size % 4, size % 7, F.lit(1))).alias("a"), vecs.to_set(F.array(size % 3, size % 5, F.lit(2))).alias("b"))
    shown = lambda x: F.array_join(x.cast("array<string>"), " ")
    return rows.select("k", shown(sets.union(c("a"), c("b"))).alias("u"), shown(sets.intersection(c("a"), c("b"))).alias("i"), shown(sets.difference(c("a"), c("b"))).alias("d"), sets.size(c("a")).alias("n"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END || ',size' AS keys, p_size AS size, CAST(NULL AS INTEGER) AS none, CAST(2 AS INTEGER) AS n FROM part""")
def q_map_fns(t: Tables) -> DataFrame:
    m = maps.insert(maps.map_singleton(F.lit("size"), c("p_size")), F.when(c("p_size") % 2 == 0, "even").otherwise("odd"), 0)
    return t.part.select(c("p_partkey").alias("k"), F.array_join(maps.keys(m), ",").alias("keys"), maps.get(m, "size").alias("size"), maps.get(m, "no").alias("none"), maps.size(m).alias("n"))


@query("SELECT c_custkey AS k, coalesce(o, 0) AS first, o IS NULL AS none, CASE WHEN o IS NOT NULL THEN o + 1 END AS next, CASE WHEN o IS NULL THEN 'no order' END AS err FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) x ON o_custkey = c_custkey")
def q_option_result(t: Tables) -> DataFrame:
    first = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    rows = t.customer.join(first, "c_custkey", "left").withColumn("r", std.ok_or(c("o"), "no order"))
    return rows.select(c("c_custkey").alias("k"), std.unwrap_or_default(c("o"), "bigint").alias("first"), std.is_none(c("o")).alias("none"), std.map_option(c("o"), lambda x: x + 1).alias("next"), c("r")["err"].alias("err"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def q_vec_embedding_dot(t: Tables) -> DataFrame:
    e = c("embedding").cast("array<double>")
    return t.embeddings.select(c("vec_id").alias("id"), F.round(vecs.fold(e, F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), vecs.vec_len(e).alias("n"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(CAST(json_extract_string(props, '$.none') AS DOUBLE), -1.0) AS missing FROM events")
def q_json_access(t: Tables) -> DataFrame:
    v = js.parse(c("props"))
    return t.events.select(c("event_id").alias("id"), js.as_number(js.get(v, "k")).alias("k"), F.coalesce(js.as_number(js.get(v, "none")), F.lit(-1.0)).alias("missing"))


@query("SELECT event_id AS id, CAST(CAST(ts AS DATE) + 1 AS DATE) AS next, CAST(CAST(ts AS DATE) - 1 AS DATE) AS before, CAST(julian(CAST(ts AS DATE)) AS BIGINT) AS jd, CAST(isodow(ts) - 1 AS INTEGER) AS wd, CAST(dayofyear(ts) AS INTEGER) AS nth, make_date(2024, CAST(month(ts) AS INTEGER), 1) AS first FROM events")
def q_date_arith(t: Tables) -> DataFrame:
    d = F.to_date("ts")
    return t.events.select(c("event_id").alias("id"), time.next_day(d).alias("next"), time.previous_day(d).alias("before"), time.julian_day(d).alias("jd"), time.weekday(d).alias("wd"), time.ordinal(d).alias("nth"), time.try_from_ymd(2024, time.month(d), 1).alias("first"))


@query("SELECT event_id AS id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc, strftime(ts, '%H:%M') AS hm FROM events")
def q_datetime_format(t: Tables) -> DataFrame:
    ts = c("ts").cast("timestamp_ntz")
    return t.events.select(c("event_id").alias("id"), time.datetime_format(ts, "%Y/%m/%d %H-%M-%S").alias("text"), time.to_rfc3339(time.utc_datetime(ts)).alias("rfc"), time.time_format(time.try_from_hms(F.hour(ts), F.minute(ts), F.second(ts)), "%H:%M").alias("hm"))


@query("SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS unix, date_trunc('second', ts) AS back FROM events")
def q_unix_timestamp(t: Tables) -> DataFrame:
    unix = F.unix_seconds(c("ts").cast("timestamp"))
    return t.events.select(c("event_id").alias("id"), unix.alias("unix"), time.datetime_from_unix_timestamp(unix).alias("back"))


@query("SELECT c_custkey AS k, floor(c_acctbal) AS fl, ceil(c_acctbal) AS ce, trunc(c_acctbal) AS tr, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS ln, round(sin(c_acctbal), 6) AS sn, round(atan2(c_acctbal, 2), 6) AS at, round(radians(c_acctbal), 6) AS rad FROM customer")
def q_fp_math(t: Tables) -> DataFrame:
    x = c("c_acctbal")
    r = lambda y: F.round(y, 6)
    return t.customer.select(
        c("c_custkey").alias("k"), fp.floor_d(x).alias("fl"), fp.ceil_d(x).alias("ce"), fp.trunc_d(x).alias("tr"), r(fp.sqrt_d(fp.abs_d(x))).alias("sq"), r(fp.ln_d(fp.abs_d(x) + 1)).alias("ln"), r(fp.sin_d(x)).alias("sn"), r(fp.atan2_d(x, 2)).alias("at"), r(fp.to_radians_d(x)).alias("rad")
    )


@query("SELECT p_partkey AS k, CAST(p_partkey * 4093 % 256 AS BIGINT) AS u8, CAST((p_partkey * 4093 + 128) % 256 - 128 AS BIGINT) AS s8, CAST(p_partkey * 1000003 % 4294967296 AS BIGINT) AS u32 FROM part")
def q_int_wrap(t: Tables) -> DataFrame:
    k = c("p_partkey")
    return t.part.select(k.alias("k"), std.wrap(k * 4093, "u8").alias("u8"), std.wrap(k * 4093, "s8").alias("s8"), std.wrap(k * 1000003, "u32").alias("u32"))


@query("SELECT p_partkey AS k, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 21) AS x, (p_partkey >> 2) & 7 AS slice, (p_partkey << 4) | (p_size & 15) AS joined FROM part")
def q_bit_ops(t: Tables) -> DataFrame:
    k, size = c("p_partkey"), c("p_size")
    return t.part.select(k.alias("k"), k.bitwiseAND(12).alias("a"), k.bitwiseOR(3).alias("o"), k.bitwiseXOR(21).alias("x"), std.bits(k, 4, 2).alias("slice"), std.bit_concat(k, std.bits(size, 3, 0), 4).alias("joined"))


@query("SELECT p_partkey AS k, CAST(p_size % 7 AS BIGINT) ** 5 AS p5, CAST(CAST((p_size % 10) ** 3 AS BIGINT) % 256 AS BIGINT) AS small FROM part")
def q_pow(t: Tables) -> DataFrame:
    size = c("p_size")
    return t.part.select(c("p_partkey").alias("k"), std.pow32(size % 7, 5, "s32").cast("double").alias("p5"), std.pow32(size % 10, 3, "u8").alias("small"))


@query(r"SELECT page_id AS id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages")
def q_url_parts(t: Tables) -> DataFrame:
    u = c("url")
    return t.pages.select(c("page_id").alias("id"), url.scheme(u).alias("scheme"), url.host_str(u).alias("host"), url.path(u).alias("path"), url.query(u).alias("query"), url.fragment(u).alias("fragment"))


@query("SELECT c_custkey AS k, '10.' || (c_custkey >> 16) % 256 || '.' || (c_custkey >> 8) % 256 || '.' || c_custkey % 256 AS ip, true AS private, CAST(167772160 + c_custkey AS BIGINT) AS back FROM customer")
def q_ipv4(t: Tables) -> DataFrame:
    ip = net.ipv4_from_u32(c("c_custkey") + 167772160)
    return t.customer.select(c("c_custkey").alias("k"), net.ipv4Addr2string(ip).alias("ip"), net.ipv4_is_private(ip).alias("private"), net.ipv4_from_str(net.ipv4Addr2string(ip)).alias("back"))


@query("SELECT c_custkey AS k, '00000000-0000-4000-8000-' || lpad(lower(hex(c_custkey)), 12, '0') AS id, '0000000000004000' || '8000' || lpad(lower(hex(c_custkey)), 12, '0') AS plain FROM customer")
def q_uuid_text(t: Tables) -> DataFrame:
    made = uuid.parse_str(F.concat(F.lit("{0000000000004000-8000-"), F.lpad(F.hex("c_custkey"), 12, "0"), F.lit("}")))
    return t.customer.select(c("c_custkey").alias("k"), made.alias("id"), uuid.to_simple_lower(made).alias("plain"))


@query("SELECT n_nationkey AS k, base64(encode(n_name)) AS b, n_name AS back FROM nation")
def q_base64(t: Tables) -> DataFrame:
    b = strings.encode(c("n_name").cast("binary"))
    return t.nation.select(c("n_nationkey").alias("k"), b.alias("b"), strings.decode(b)["ok"].cast("string").alias("back"))


@query()
def q_hash_partition(t: Tables) -> DataFrame:
    """The hash is the engine's own, so there is no SQL for it."""
    return t.customer.groupBy(F.pmod(std.hash64(c("c_custkey")), F.lit(8)).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT s_name AS name, CAST(row_number() OVER (ORDER BY s_name) * 2 AS BIGINT) AS number FROM supplier")
def q_allocate(t: Tables) -> DataFrame:
    """Odd numbers are taken, and the range has an even one for each supplier."""
    most = 2 * t.supplier.count()
    return allocate.allocate_relation(t.supplier.select(c("s_name").alias("name")), t.spark.range(1, most, 2), "number", 1, most)


@query("SELECT p_partkey AS k, p_brand || p_type AS cat, CAST(strlen(p_name) AS INTEGER) AS n, regexp_full_match(p_brand, 'Brand#1[0-9]') AS m, CAST((p_size > 10 AND p_partkey % 2 = 1) AS INTEGER) AS both, coalesce(TRY_CAST(right(p_brand, 2) AS INTEGER), 0) AS number FROM part")
def q_dialect_fns(t: Tables) -> DataFrame:
    k, size = c("p_partkey"), c("p_size")
    return t.part.select(
        k.alias("k"), datalog.cat(c("p_brand"), c("p_type")).alias("cat"), datalog.strlen(c("p_name")).alias("n"), datalog.re_match("Brand#1[0-9]", c("p_brand")).alias("m"), datalog.land((size > 10).cast("int"), k % 2).alias("both"), datalog.to_number(F.right(c("p_brand"), F.lit(2))).alias("number")
    )


@query("SELECT p_partkey AS k, (p_partkey % 65536 % 256) * 256 + p_partkey % 65536 // 256 AS swapped, NOT (p_size > 25) OR p_retailprice > 1000 AS implied FROM part")
def q_byte_order(t: Tables) -> DataFrame:
    return t.part.select(c("p_partkey").alias("k"), std.ntohs(c("p_partkey") % 65536).cast("long").alias("swapped"), std.implies(c("p_size") > 25, c("p_retailprice") > 1000).alias("implied"))
