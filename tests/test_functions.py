import datetime

import pytest
from pyspark.sql import functions as F

from rulespark import functions
from rulespark.functions import allocate, datalog, fp, groups, json, logs, maps, net, ovsdb, regex, sets, sql, std, strings, time, url, uuid, vecs

ADDRESS = "https://me:pw@Host.example:8443/a/b?q=1#top"
D = lambda y, m, d: F.lit(datetime.date(y, m, d))
CASES = {
    "unwrap": (lambda: std.unwrap_or(F.lit(None).cast("int"), 4), 4), "default": (lambda: std.default("string"), ""), "ok": (lambda: std.is_ok(std.ok(1)), True), "err": (lambda: std.is_err(std.err("no", "int")), True),
    "map result": (lambda: std.map_result(std.ok(2), lambda x: x + 1)["ok"], 3), "map err": (lambda: std.map_err(std.err("a", "int"), F.upper)["err"], "A"), "ok or else": (lambda: std.ok_or_else(F.lit(None).cast("int"), lambda: F.lit("none"))["err"], "none"),
    "result or": (lambda: std.result_unwrap_or(std.err("x", "int"), 9), 9), "option set": (lambda: std.to_set(F.lit(3)), [3]), "u8": (lambda: std.wrap(300, "u8"), 44), "s8": (lambda: std.wrap(200, "s8"), -56), "u64": (lambda: std.wrap(-1, "u64").cast("string"), str(2**64 - 1)),
    "pow": (lambda: std.u8_pow32(3, 7), 3**7 % 256), "pow signed": (lambda: std.s32_pow32(-7, 13), (-(7**13) + 2**31) % 2**32 - 2**31), "pow64": (lambda: std.u64_pow32(7, 40).cast("string"), str(7**40 % 2**64)), "bigint": (lambda: std.bigint_pow32("12", 40), str(12**40)),
    "u128": (lambda: std.u128_pow32("3", 100), str(3**100 % 2**128)), "slice": (lambda: std.bits(0b110110, 4, 2), 0b101), "concat bits": (lambda: std.bit_concat(3, 5, 4), 53), "shift": (lambda: std.shift_left(2**31, 1, "u32"), 0), "hex": (lambda: std.hex(255), "ff"),
    "parse u64": (lambda: std.parse_dec_u64("18446744073709551615").cast("string"), str(2**64 - 1)), "parse bad": (lambda: std.parse_dec_i64("1x"), None), "range": (lambda: std.range_vec(1, 4), [1, 2, 3]), "range down": (lambda: std.range_vec(4, 1, -1), [4, 3, 2]), "range none": (lambda: std.range_vec(4, 4), []),
    "ntohl": (lambda: std.ntohl(0x01020304), 0x04030201), "ntohs": (lambda: std.ntohs(0x0102), 0x0201), "implies": (lambda: std.implies(True, False), False), "least": (lambda: std.min(2, 1), 1),
    "bytes": (lambda: strings.len("é"), 2), "substr": (lambda: strings.substr("héllo", 0, 3), "hé"), "substr beyond": (lambda: strings.substr("abc", 2, 99), "c"), "split": (lambda: strings.split("a.b..c", "."), ["a", "b", "", "c"]), "to bytes": (lambda: strings.to_bytes("é!"), [195, 169, 33]),
    "no bytes": (lambda: strings.to_bytes(""), []), "from utf8": (lambda: strings.from_utf8(F.array(F.lit(195), F.lit(169)))["ok"], "é"), "bad utf8": (lambda: strings.from_utf8(F.array(F.lit(195)))["err"], "invalid UTF-8"), "utf16": (lambda: strings.encode_utf16("a😀"), [97, 55357, 56832]),
    "from utf16": (lambda: strings.from_utf16(F.array(F.lit(97), F.lit(233)))["ok"], "aé"), "trim": (lambda: strings.trim("  a b\t"), "a b"), "join": (lambda: strings.join(F.array(F.lit("a"), F.lit("b")), ", "), "a, b"), "bad base64": (lambda: strings.decode("*")["err"], "invalid base64"),
    "zip": (lambda: vecs.zip(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))), [(1, "a")]), "resize": (lambda: vecs.resize(F.array(F.lit(1)), 3, 0), [1, 0, 0]), "truncate": (lambda: vecs.truncate(F.array(F.lit(1), F.lit(2)), 1), [1]), "pop": (lambda: vecs.pop(F.array(F.lit(1), F.lit(2))), [1]),
    "sort by": (lambda: vecs.sort_by(F.array(F.lit("bb"), F.lit("a"), F.lit("cc")), F.length), ["a", "bb", "cc"]), "arg min": (lambda: vecs.arg_min(F.array(F.lit(3), F.lit(-5), F.lit(1)), F.abs), 1), "flatmap": (lambda: vecs.flatmap(F.array(F.lit(1), F.lit(2)), lambda x: F.array(x, x)), [1, 1, 2, 2]),
    "filter map": (lambda: vecs.filter_map(F.array(F.lit(1), F.lit(2)), lambda x: F.when(x > 1, x * 10)), [20]), "update": (lambda: vecs.update_nth(F.array(F.lit(1), F.lit(2)), 1, 9), [1, 9]), "last": (lambda: vecs.last(F.array(F.lit(1), F.lit(2))), 2), "find": (lambda: vecs.find(F.array(F.lit(1), F.lit(2)), lambda x: x > 1), 2),
    "set insert": (lambda: sets.insert(F.array(F.lit(1), F.lit(3)), 2), [1, 2, 3]), "set remove": (lambda: sets.remove(F.array(F.lit(1), F.lit(3)), 1), [3]), "unions": (lambda: sets.unions(F.array(F.array(F.lit(2)), F.array(F.lit(1), F.lit(2)))), [1, 2]),
    "map union": (lambda: maps.union(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))), {"a": 2}), "map values": (lambda: maps.values(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), [2, 1]), "nth key": (lambda: maps.nth_key(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), 0), "a"),
    "map fold": (lambda: maps.fold(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), F.lit(""), lambda a, k, v: F.concat(a, k, v)), "a2b1"), "round": (lambda: fp.round_d(-2.5), -3.0), "fract": (lambda: fp.fract_d(-1.25), -0.25), "nan": (lambda: fp.is_nan_d(fp.sqrt_d(-1.0)), True), "to int": (lambda: fp.int_from_d(-7.9).cast("int"), -7),
    "json get": (lambda: json.as_string(json.get(json.parse('{"a": "x"}'), "a")), "x"), "json pointer": (lambda: json.as_number(json.get_by_ptr(json.parse('{"a": [1, {"b": 4}]}'), "/a/1/b")), 4.0), "json set": (lambda: F.to_json(json.set_by_ptr(json.parse('{"a":[1,2]}'), "/a/0", json.parse("7"))), '{"a":[7,2]}'),
    "json wrong kind": (lambda: json.as_bool(json.parse("1")), None), "bad json": (lambda: json.from_json_string("{", "a int")["err"], "invalid JSON"), "regex set": (lambda: regex.regex_set_match(["a", "z", "b$"], "ab"), [0, 2]), "regex first": (lambda: regex.regex_first_match("[0-9]+", "a12b3"), "12"),
    "time": (lambda: time.time2string(time.try_from_hms_milli(1, 2, 3, 40)), "01:02:03.04"), "bad time": (lambda: time.try_from_hms(24, 0, 0), None), "parse time": (lambda: time.string2time("01:02:03"), 3723 * 10**9), "hour": (lambda: time.hour(time.string2time("23:59:58")), 23), "micro": (lambda: time.microsecond(time.string2time("00:00:00.000123")), 123),
    "date": (lambda: time.date2string(time.try_from_yo(2024, 60)), "2024-02-29"), "bad date": (lambda: time.try_from_ymd(2023, 2, 29), None), "iso week": (lambda: time.date2string(time.try_from_iso_ywd(2024, 1, 1)), "2024-01-01"), "julian": (lambda: time.julian_day(D(2000, 1, 1)), 2451545), "from julian": (lambda: time.date2string(time.from_julian_day(2451545)), "2000-01-01"),
    "weekday": (lambda: time.weekday(D(2024, 1, 1)), 0), "format": (lambda: time.date_format(D(2024, 3, 5), "%d of %B"), "05 of March"), "rfc3339": (lambda: time.to_rfc3339(time.tz_datetime_parse_from_rfc3339("2024-01-01T10:00:00+02:00")), "2024-01-01T10:00:00+02:00"),
    "rfc2822": (lambda: time.to_rfc2822(time.tz_datetime_parse_from_rfc2822("Mon, 01 Jan 2024 10:00:00 -0130")), "Mon, 01 Jan 2024 10:00:00 -0130"), "unix": (lambda: time.dateTime2string(time.datetime_from_unix_timestamp(86400)), "1970-01-02T00:00:00"),
    "ipv4": (lambda: net.ipv4Addr2string(net.ipv4_from_str("10.0.255.1")), "10.0.255.1"), "bad ipv4": (lambda: net.ipv4_from_str("10.0.256.1"), None), "multicast": (lambda: net.ipv4_is_multicast(net.ipv4_new(224, 0, 0, 1)), True), "ipv6": (lambda: net.ipv6Addr2string(net.ipv6_from_str("2001:db8::1")), "2001:db8::1"),
    "mapped": (lambda: net.ipv6_to_ipv4(net.ipv4_to_ipv6_mapped(net.ipv4_new(1, 2, 3, 4))), 0x01020304), "segments": (lambda: net.ipv6_segment_vec(net.iPV6_LOCALHOST()), [0] * 7 + [1]), "u128 address": (lambda: net.ipv6_to_u128(net.ipv6_from_u128("5")), "5"), "either": (lambda: net.ipaddr_is_loopback(net.ipaddr_from_ipv4addr(net.iPV4_LOCALHOST())), True),
    "host": (lambda: url.host_str(ADDRESS), "host.example"), "user": (lambda: url.username(ADDRESS), "me"), "password": (lambda: url.password(ADDRESS), "pw"), "port": (lambda: url.port(ADDRESS), 8443), "known port": (lambda: url.port_or_known_default("http://a/"), 80), "path": (lambda: url.path("http://a"), "/"), "query": (lambda: url.query(ADDRESS), "q=1"),
    "fragment": (lambda: url.fragment(ADDRESS), "top"), "no url": (lambda: url.url_parse("x y"), None), "url join": (lambda: url.join("http://a/b/c", "../d"), "http://a/d"), "v5": (lambda: uuid.new_v5(uuid.nAMESPACE_DNS(), "python.org"), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
    "uuid": (lambda: uuid.parse_str("{6BA7B8109DAD11D180B400C04FD430C8}"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), "uuid number": (lambda: uuid.from_u128(uuid.as_u128(uuid.nAMESPACE_URL())), uuid.NAMESPACES["URL"]), "uuid le": (lambda: uuid.from_u128_le(uuid.to_u128_le(uuid.nAMESPACE_URL())), uuid.NAMESPACES["URL"]), "nil": (lambda: uuid.is_nil(uuid.nil()), True),
    "sql and": (lambda: sql.b_and(F.lit(None).cast("boolean"), False), None), "sql dow": (lambda: sql.sql_extract_dow(D(2024, 1, 7)), 0), "unwrap bool": (lambda: sql.unwrapBool(F.lit(None).cast("boolean")), False), "sql length": (lambda: sql.sql_array_length(F.lit(None).cast("array<int>")), None), "limit": (lambda: sql.limit(F.array(F.lit(1), F.lit(2)), 1), [1]),
    "avg": (lambda: sql.avg_signed_N(-7, 2), -3), "match": (lambda: datalog.re_match("a.c", "xabc"), False), "number": (lambda: datalog.to_number("x"), 0), "land": (lambda: datalog.land(2, 0), 0), "utoi": (lambda: datalog.utoi(2**32 - 1), -1), "dialect substr": (lambda: datalog.substr("hello", 1, 3), "ell"),
    "allocate": (lambda: F.transform(allocate.allocate(F.array(F.lit(1), F.lit(3)), F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, 4), lambda s: s["number"]), [2, 4]), "hinted": (lambda: allocate.allocate_with_hint(F.array(F.lit(1)), F.array(F.struct(F.lit("a").alias("who"), F.lit(5).alias("hint")), F.struct(F.lit("b").alias("who"), F.lit(1).alias("hint"))), 1, 9), [("a", 5), ("b", 2)]),
    "adjust": (lambda: allocate.adjust_allocation(F.create_map(F.lit("a"), F.lit(2)), F.array(F.lit("b"), F.lit("a")), 1, 3), [("a", 2), ("b", 1)]), "uuid name": (lambda: ovsdb.uuid2name("A-b"), "ua_b"), "any value": (lambda: std.from_any(json.parse("5"), "int"), 5),
}


def test_values(spark):
    made = spark.range(1).select(*(f().alias(f"c{i}") for i, (f, _) in enumerate(CASES.values()))).first()
    got = dict(zip(CASES, made))
    shown = lambda x: [tuple(y) if hasattr(y, "asDict") else y for y in x] if isinstance(x, list) else x
    wrong = {k: (shown(got[k]), w) for k, (_, w) in CASES.items() if shown(got[k]) != w}
    assert not wrong


def test_groups(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "b", 1), (2, "c", 5)], "k long, v string, n long").distinct()
    n, v = F.col("n"), F.col("v")
    got = df.groupBy("k").agg(
        groups.to_set(v).alias("s"), groups.arg_min(v, n).alias("lo"), groups.arg_max(v, n).alias("hi"), groups.sum_of(n).alias("sum"), groups.nth(v, 1).alias("second"), groups.to_map(v, n).alias("m"), groups.filter(n, lambda x: x > 1).alias("big"),
        groups.find(n, lambda x: x > 2).alias("found"), groups.fold(n, F.lit(0).cast("long"), lambda a, x: a * 10 + x).alias("fold"), groups.map(n, lambda x: -x).alias("neg"), sql.agg_avg_signed_R(n).alias("mean"), ovsdb.group2set_remove_sentinel(v, "a").alias("kept"),
    )
    rows = {r.k: r.asDict() for r in got.collect()}
    assert rows[1] == {"k": 1, "s": ["a", "b"], "lo": "b", "hi": "a", "sum": 4, "second": "b", "m": {"a": 3, "b": 1}, "big": [3], "found": 3, "fold": 13, "neg": [-1, -3], "mean": 2, "kept": ["b"]}
    assert rows[2]["second"] is None


def test_names_are_found():
    for name in ("hash64", "string_contains", "vec_sort", "set_union", "map_get", "group_count_distinct", "floor_f", "jval_get", "regex_match", "to_rfc2822", "ipv4_new", "port", "new_v5", "agg_sum_int_N", "land", "allocate", "uuid2str", "warn"):
        assert callable(functions.find(name))
    with pytest.raises(KeyError):
        functions.find("nothing")


def test_logs_and_watch(spark):
    df, seen = logs.watch(spark.range(5), "five")
    assert df.where(logs.warn(F.col("id"))).count() == 5
    assert seen.get == {"rows": 5}
