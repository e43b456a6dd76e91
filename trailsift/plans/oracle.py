"""DuckDB oracle SQL for the registered queries (same column names as the Spark side).

These restate each operator from its definition, independently of the Spark
plans: the minute series uses a dense spine and a RANGE window, DBSCAN uses an
all-pairs neighbour join over distinct vectors and a recursive CTE for the
components. Tables ``events`` etc. are views registered by the caller.
"""

from __future__ import annotations

from trailsift.functions.scalars import OS_RULES, READONLY_TRUE, SERVICE_SUFFIX
from trailsift.operators.signatures import SIGNATURES
from trailsift.sources.adapter import (CLICK_NAMES, ERROR_NAMES, REGIONS, USER_AGENTS,
                                       VIEW_NAMES)

TIME_START_SQL = "TIMESTAMP '2024-01-05 00:00:00'"
TIME_END_SQL = "TIMESTAMP '2024-01-12 12:30:00'"
SERVICES = ["ec2", "s3"]
EPS2 = 1.5 * 1.5
MIN_SAMPLES = 20
FEATS = [f"f{i:02d}" for i in range(13)]
ZS = [f"z{i:02d}" for i in range(13)]

_IPV4 = (r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
         r"\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
_STR_RE = r'"(?:[^"\\]|\\.)*"'


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _s(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def h32(x: str) -> str:
    s = _s(x)
    u = f"('0x' || substr(md5({s}), 1, 8))::BIGINT"
    return f"(CASE WHEN {s} = '' THEN 0 ELSE {u} - CASE WHEN {u} >= 2147483648 THEN 4294967296 ELSE 0 END END)"


def ip_int(x: str) -> str:
    s = _s(x)
    parts = " + ".join(f"TRY_CAST(split_part({s}, '.', {i + 1}) AS BIGINT) * {m}"
                       for i, m in enumerate([16777216, 65536, 256, 1]))
    return f"(CASE WHEN regexp_full_match({s}, {_q(_IPV4)}) THEN {parts} ELSE {h32(s)} END)"


def ua_num(x: str) -> str:
    s = _s(x)
    return f"(length({s})::BIGINT * 65536 + ({h32(f'substr({s}, 1, 4)')} & 65535))"


def _count_re(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, {_q(pattern)}, '', 'g')))"


def json_len(x: str) -> str:
    compact = f"regexp_replace({x}, {_q('(' + _STR_RE + r')|\s+')}, '\\1', 'g')"
    structure = f"regexp_replace({compact}, {_q(_STR_RE)}, '', 'g')"
    return (f"(CASE WHEN {x} IS NULL THEN 4 ELSE length({compact}) + {_count_re(structure, '[,:]')}"
            f" + 5 * {_count_re(compact, r'[\x{7F}-\x{FFFF}]')}"
            f" + 11 * {_count_re(compact, r'[\x{10000}-\x{10FFFF}]')} END)::BIGINT")


def num_keys(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'OBJECT' THEN len(json_keys({x})) ELSE 0 END)::BIGINT"


def guess_os(x: str) -> str:
    s = f"lower({_s(x)})"
    whens = " ".join("WHEN " + " OR ".join(f"contains({s}, {_q(w)})" for w in words)
                     + f" THEN {_q(name)}" for name, words in OS_RULES)
    return f"(CASE {whens} ELSE 'Unknown' END)"


_FALSY = "('null', '\"\"', '0', '0.0', 'false', '[]', '{}')"


def _scalar_text(x: str) -> str:
    t = f"trim({x})"
    return (f"(CASE WHEN {x} IS NULL OR {t} IN {_FALSY} THEN '' ELSE "
            f"coalesce(json_extract_string('{{\"v\":' || {t} || '}}', '$.v'), {t}) END)")


def _is_obj(x: str) -> str:
    return f"coalesce(starts_with(ltrim({x}), '{{'), false)"


def ident_type(x: str) -> str:
    return (f"(CASE WHEN {_is_obj(x)} THEN coalesce(json_extract_string({x}, '$.type'), '') "
            f"ELSE {_scalar_text(x)} END)")


def iam(x: str) -> str:
    first = ", ".join(f"nullif(json_extract_string({x}, '$.{k}'), '')"
                      for k in ("arn", "userName", "principalId"))
    return f"(CASE WHEN {_is_obj(x)} THEN coalesce({first}, '') ELSE {_scalar_text(x)} END)"


def issuer(x: str) -> str:
    return f"coalesce(json_extract_string({x}, '$.sessionIssuer.type'), '')"


def _pick(idx: str, values: list[str]) -> str:
    return "(CASE " + " ".join(f"WHEN {idx} = {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END)"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


FEATURE_SQL = [
    h32("eventName"), h32("eventSource"), h32("eventCategory"), h32("eventType"),
    h32(ident_type("userIdentity")), h32(issuer("sessionContext")), h32("recipientAccountId"),
    ip_int("sourceIPAddress"), h32("awsRegion"), ua_num("userAgent"),
    "(coalesce(errorCode, '') <> '')::INT", num_keys("requestParameters"),
    json_len("responseElements"),
]

CTE: dict[str, str] = {}
CTE["ev0"] = """SELECT event_id, ts, user_id AS u, event_type AS et, value, props,
  TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
CTE["ev1"] = f"""SELECT *, CASE WHEN et = 'view' THEN {_pick('k % 3', VIEW_NAMES)}
  WHEN et = 'click' THEN {_pick('k % 2', CLICK_NAMES)}
  WHEN et = 'error' THEN {_pick('k % 4', ERROR_NAMES)}
  WHEN et = 'purchase' THEN 'RunInstances' WHEN et = 'signup' THEN 'CreateUser' END AS eventName
  FROM ev0"""
CTE["audit"] = ("""SELECT event_id, ts AS eventTime, eventName,
  CASE WHEN starts_with(eventName, 'Describe') OR eventName = 'RunInstances' THEN 'ec2.amazonaws.com'
       WHEN eventName IN ('ListBuckets', 'GetBucketAcl') THEN 's3.amazonaws.com'
       ELSE 'iam.amazonaws.com' END AS eventSource,
  'Management' AS eventCategory, 'AwsApiCall' AS eventType,
  CASE WHEN u % 3 = 0 THEN '{"type":"IAMUser","arn":"arn:aws:iam::12345678901' || (u % 2)::VARCHAR
         || ':user/u' || u::VARCHAR || '"}'
       WHEN u % 3 = 1 THEN '{"type":"AssumedRole","userName":"user' || u::VARCHAR || '"}'
       ELSE '{"type":"Root","principalId":"AID' || u::VARCHAR || '"}' END AS userIdentity,
  CASE WHEN u % 3 = 1 THEN '{"sessionIssuer":{"type":"Role"}}' END AS sessionContext,
  (u % 2)::VARCHAR AS recipientAccountId, """ + _pick("u % 2", REGIONS) + """ AS awsRegion,
  '10.0.' || (u % 4)::VARCHAR || '.' || (u % 8)::VARCHAR AS sourceIPAddress,
  """ + _pick("u % 5", USER_AGENTS) + """ AS userAgent,
  CASE WHEN et = 'error' AND k % 4 <> 3 THEN 'AccessDenied'
       WHEN et = 'error' THEN 'Client.UnauthorizedOperation'
       WHEN et = 'click' AND value < 5 THEN 'ThrottlingException' END AS errorCode,
  CASE WHEN et <> 'view' THEN props END AS requestParameters,
  CASE WHEN et = 'click' THEN props END AS responseElements,
  CASE WHEN et IN ('view', 'click', 'error') THEN 'true' ELSE 'false' END AS readOnly,
  NULL::VARCHAR AS raw
  FROM ev1""")
CTE["ro"] = f"SELECT * FROM audit WHERE lower(CAST(readOnly AS VARCHAR)) IN {_in(READONLY_TRUE)}"
CTE["feat"] = ("SELECT event_id, eventTime, eventName, errorCode, sourceIPAddress, userIdentity, "
               "userAgent, " + ", ".join(f"CAST({e} AS DOUBLE) AS {f}"
                                          for e, f in zip(FEATURE_SQL, FEATS)) + " FROM ro")
CTE["st"] = "SELECT " + ", ".join(
    f"avg({f}) AS m{f}, stddev_pop({f}) AS s{f}, min({f}) = max({f}) AS c{f}" for f in FEATS) + " FROM feat"
CTE["vec"] = "SELECT " + ", ".join(FEATS) + ", count(*) AS w FROM feat GROUP BY ALL"
CTE["zv"] = ("SELECT vec.*, row_number() OVER (ORDER BY " + ", ".join(reversed(FEATS)) + ") AS vid, "
             + ", ".join(f"CASE WHEN c{f} THEN 0.0 ELSE ({f} - m{f}) / s{f} END AS {z}"
                         for f, z in zip(FEATS, ZS)) + " FROM vec, st")
CTE["nb"] = ("SELECT a.vid AS a, b.vid AS b, b.w AS bw FROM zv a JOIN zv b ON "
             + " + ".join(f"(a.{z} - b.{z}) * (a.{z} - b.{z})" for z in ZS) + f" <= {EPS2}")
CTE["cnt"] = "SELECT a AS vid, sum(bw)::BIGINT AS nbr_weight FROM nb GROUP BY a"
CTE["core"] = f"SELECT vid FROM cnt WHERE nbr_weight >= {MIN_SAMPLES}"
CTE["ce"] = ("SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.vid "
             "JOIN core c2 ON nb.b = c2.vid")
CTE["reach"] = ("SELECT vid, vid AS lbl FROM core UNION "
                "SELECT ce.b, reach.lbl FROM reach JOIN ce ON reach.vid = ce.a")
CTE["comp"] = "SELECT vid, min(lbl) AS root FROM reach GROUP BY vid"
CTE["cnum"] = ("SELECT vid, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster FROM comp")
CTE["border"] = ("SELECT nb.a AS vid, min(cnum.cluster) AS cluster FROM nb JOIN cnum ON nb.b = cnum.vid "
                 "WHERE nb.a NOT IN (SELECT vid FROM core) GROUP BY nb.a")
CTE["vlab"] = ("SELECT zv.*, cnt.nbr_weight, zv.vid IN (SELECT vid FROM core) AS core, "
               "coalesce(cnum.cluster, border.cluster, -1)::INT AS cluster FROM zv "
               "JOIN cnt USING (vid) LEFT JOIN cnum USING (vid) LEFT JOIN border USING (vid)")
CTE["lab"] = ("SELECT feat.*, vlab.cluster FROM feat JOIN vlab USING (" + ", ".join(FEATS) + ")")
CTE["prof"] = """SELECT cluster, count(*) AS size,
  avg(CASE WHEN errorCode IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS error_rate,
  list_sort(list_distinct(list(coalesce(eventName, '')))) AS names,
  count(DISTINCT coalesce(eventName, '')) AS n_event_names
  FROM lab WHERE cluster <> -1 GROUP BY cluster"""
CTE["top"] = """SELECT cluster, error_rate, size,
  row_number() OVER (ORDER BY error_rate DESC, size DESC, cluster ASC) AS rank
  FROM prof QUALIFY rank <= 3"""
CTE["flagged"] = ("SELECT lab.*, top.rank, top.rank IS NOT NULL AS suspicious "
                  "FROM lab LEFT JOIN top USING (cluster)")


def minutes_cte(source: str, flag: str, prefix: str, window: int, threshold: float) -> dict:
    """Dense-spine minute series, rolling sums, density and islands over ``source``."""
    p = prefix
    return {
        f"{p}min": f"""SELECT date_trunc('minute', eventTime) AS minute, count(eventName) AS total,
  count(eventName) FILTER (WHERE {flag}) AS susp FROM {source}
  WHERE eventTime IS NOT NULL GROUP BY 1""",
        f"{p}spine": f"""SELECT unnest(generate_series(min(minute), max(minute), INTERVAL 1 MINUTE)) AS minute
  FROM {p}min""",
        f"{p}dense": f"""SELECT s.minute, coalesce(m.total, 0) AS total, coalesce(m.susp, 0) AS susp
  FROM {p}spine s LEFT JOIN {p}min m USING (minute)""",
        f"{p}roll": f"""SELECT minute, sum(total) OVER w AS roll_total, sum(susp) OVER w AS roll_susp
  FROM {p}dense WINDOW w AS (ORDER BY minute RANGE BETWEEN INTERVAL {window - 1} MINUTE PRECEDING
  AND CURRENT ROW)""",
        f"{p}dens": f"""SELECT minute, roll_total, roll_susp,
  CASE WHEN roll_total = 0 THEN 0.0::DOUBLE ELSE roll_susp::DOUBLE / roll_total::DOUBLE END AS density FROM {p}roll""",
        f"{p}runs": f"""SELECT minute, density, density >= {threshold} AS flag,
  sum(CASE WHEN density >= {threshold} THEN 0 ELSE 1 END) OVER (ORDER BY minute) AS grp FROM {p}dens""",
        f"{p}tf": f"""SELECT min(minute) AS tf_start,
  least(max(minute) + INTERVAL 1 MINUTE, (SELECT max(minute) FROM {p}min)) AS tf_end,
  max(density) AS confidence FROM {p}runs WHERE flag GROUP BY grp""",
    }


CTE.update(minutes_cte("ro", "errorCode IS NOT NULL", "e_", 60, 0.10))
CTE.update(minutes_cte("flagged", "suspicious", "s_", 60, 0.10))
CTE.update(minutes_cte("flagged", "suspicious", "f_", 5, 0.40))
CTE["sigflag"] = (f"SELECT ro.*, eventName IN {_in(sorted({n for names in SIGNATURES.values() for n in names}))} "
                  "AS suspicious FROM ro")
CTE.update(minutes_cte("sigflag", "suspicious", "g_", 60, 0.10))
CTE["tfev"] = """SELECT s_tf.tf_start, s_tf.tf_end, flagged.* FROM flagged JOIN s_tf
  ON flagged.eventTime >= s_tf.tf_start AND flagged.eventTime <= s_tf.tf_end WHERE flagged.suspicious"""
CTE["tfid"] = (f"SELECT tf_start, event_id AS ord, coalesce(sourceIPAddress, '') AS ip, "
               f"{iam('userIdentity')} AS iam, coalesce(userAgent, '') AS user_agent, "
               f"{guess_os('userAgent')} AS os FROM tfev")
CTE["tfapi"] = """SELECT tf_start, list_sort(list_distinct(list(coalesce(eventName, '')))) AS apis,
  count(*) AS n_identities FROM tfev GROUP BY tf_start"""

# Dependencies between the CTEs (each name lists what it reads).
DEPS = {
    "ev0": [], "ev1": ["ev0"], "audit": ["ev1"], "ro": ["audit"], "feat": ["ro"],
    "st": ["feat"], "vec": ["feat"], "zv": ["vec", "st"], "nb": ["zv"], "cnt": ["nb"],
    "core": ["cnt"], "ce": ["nb", "core"], "reach": ["core", "ce"], "comp": ["reach"],
    "cnum": ["comp"], "border": ["nb", "cnum", "core"], "vlab": ["zv", "cnt", "cnum", "border",
                                                                 "core"],
    "lab": ["feat", "vlab"], "prof": ["lab"], "top": ["prof"], "flagged": ["lab", "top"],
    "sigflag": ["ro"], "tfev": ["flagged", "s_tf"], "tfid": ["tfev"], "tfapi": ["tfev"],
}
for _p, _src in (("e_", "ro"), ("s_", "flagged"), ("f_", "flagged"), ("g_", "sigflag")):
    DEPS.update({f"{_p}min": [_src], f"{_p}spine": [f"{_p}min"],
                 f"{_p}dense": [f"{_p}spine", f"{_p}min"], f"{_p}roll": [f"{_p}dense"],
                 f"{_p}dens": [f"{_p}roll"], f"{_p}runs": [f"{_p}dens"],
                 f"{_p}tf": [f"{_p}runs", f"{_p}min"]})


def with_ctes(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in DEPS[n]:
            visit(dep)
        order.append(n)
    for n in needed:
        visit(n)
    recursive = "RECURSIVE " if "reach" in order else ""
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    return f"WITH {recursive}{ctes}\n{body}"


def _round(x: str, places: int = 6) -> str:
    return f"round({x}, {places})"


def _join(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _prefix_groups(arr: str) -> str:
    """'prefix: a, b | prefix2: c' with prefixes in order of first appearance."""
    def pre(v):
        return f"(CASE WHEN contains({v}, '.') THEN split_part({v}, '.', 1) ELSE 'Other' END)"
    prefixes = f"list_transform({arr}, lambda x: {pre('x')})"
    firsts = f"list_filter({prefixes}, lambda p, i: list_position({prefixes}, p) = i)"
    return (f"array_to_string(list_transform({firsts}, lambda p: p || ': ' || "
            f"array_to_string(list_filter({arr}, lambda y: {pre('y')} = p), ', ')), ' | ')")


SQL: dict[str, str] = {}
SQL["audit_events"] = with_ctes("SELECT * FROM audit", "audit")
SQL["envelope_records"] = with_ctes(
    "SELECT event_id, eventTime, eventName, eventSource, errorCode, readOnly, "
    + ", ".join(FEATS) + " FROM (SELECT *, " + ", ".join(
        f"CAST({e} AS DOUBLE) AS {f}" for e, f in zip(FEATURE_SQL, FEATS)) + " FROM audit)",
    "audit")
SQL["json_missing_vs_null"] = with_ctes(
    f"""SELECT event_id, errorCode IS NOT NULL AS error_key_present,
  CAST((coalesce(errorCode, '') <> '')::INT AS DOUBLE) AS error_flag_null,
  CAST({json_len('responseElements')} AS DOUBLE) AS resp_len_null,
  CAST(CASE WHEN errorCode IS NULL THEN 1 ELSE (errorCode <> '')::INT END AS DOUBLE) AS error_flag_nan,
  CAST(CASE WHEN responseElements IS NULL THEN 3 ELSE {json_len('responseElements')} END AS DOUBLE)
    AS resp_len_nan, CAST({h32("''")} AS DOUBLE) AS region_everywhere_absent,
  CAST({h32("'nan'")} AS DOUBLE) AS region_absent_here FROM audit""", "audit")
SQL["ingest_files"] = with_ctes(
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN eventName END AS eventName,
  CASE WHEN event_id % 2 = 0 AND event_id % 10 <> 0 THEN 2 ELSE 1 END::BIGINT AS n FROM audit""", "audit")
SQL["large_envelopes"] = with_ctes("SELECT event_id, eventTime, eventName, userAgent, readOnly FROM audit", "audit")
SQL["bad_files"] = "SELECT 'no JSON object or list' AS reason, count(DISTINCT event_type) AS n FROM events"
SQL["absent_fields"] = with_ctes("SELECT event_id, eventName FROM audit", "audit")
SQL["time_range"] = with_ctes(
    f"SELECT event_id, eventTime, eventName FROM audit WHERE eventTime >= {TIME_START_SQL} "
    f"AND eventTime <= {TIME_END_SQL}", "audit")
SQL["service_filter"] = with_ctes(
    f"SELECT event_id, eventSource FROM audit WHERE replace(eventSource, {_q(SERVICE_SUFFIX)}, '') "
    f"IN {_in(SERVICES)}", "audit")
SQL["readonly_filter"] = with_ctes("SELECT event_id, readOnly, eventName FROM ro", "ro")
SQL["scalar_hash32"] = with_ctes(
    f"SELECT event_id, {h32('eventName')} AS h_name, {h32('userAgent')} AS h_agent, "
    f"{h32('errorCode')} AS h_error, {h32('awsRegion')} AS h_region FROM audit", "audit")
SQL["scalar_ip_int"] = with_ctes(
    f"SELECT event_id, {ip_int('sourceIPAddress')} AS ip_int, "
    f"{ip_int(chr(39) + 'host-' + chr(39) + ' || sourceIPAddress || ' + chr(39) + '.example' + chr(39))} AS host_int, "
    f"{ip_int(chr(39) + '3' + chr(39) + ' || sourceIPAddress')} AS wide_int FROM audit", "audit")
SQL["scalar_user_agent_num"] = with_ctes(
    f"SELECT event_id, {ua_num('userAgent')} AS ua_num, {ua_num('errorCode')} AS err_num FROM audit",
    "audit")
_RICH = _q('{"a": [1, 2, {"b": "x:y, z"}], "q": "say \\"hi\\"", "e": "café \U0001F600", "k": ')
SQL["scalar_json_length"] = with_ctes(
    f"SELECT event_id, {json_len('requestParameters')} AS req_len, "
    f"{json_len('responseElements')} AS resp_len, "
    f"{json_len('(' + _RICH + ' || event_id::VARCHAR || ' + _q('}') + ')')} AS rich_len FROM audit",
    "audit")
SQL["scalar_num_keys"] = with_ctes(
    f"SELECT event_id, {num_keys('requestParameters')} AS req_keys, "
    f"{num_keys('userIdentity')} AS ident_keys, {num_keys('sessionContext')} AS session_keys "
    f"FROM audit", "audit")
SQL["scalar_os"] = with_ctes(f"SELECT event_id, {guess_os('userAgent')} AS os FROM audit", "audit")
SQL["identity_tuple"] = with_ctes(
    f"SELECT event_id, coalesce(sourceIPAddress, '') AS ip, {iam('userIdentity')} AS iam, "
    f"coalesce(userAgent, '') AS user_agent, {guess_os('userAgent')} AS os, "
    f"{ident_type('userIdentity')} AS identity_type, {issuer('sessionContext')} AS issuer_type "
    f"FROM audit", "audit")
SQL["features_encoded"] = with_ctes("SELECT event_id, " + ", ".join(FEATS) + " FROM feat", "feat")
SQL["features_scaled"] = with_ctes(
    "SELECT event_id, " + ", ".join(
        f"round(CASE WHEN c{f} THEN 0.0 ELSE ({f} - m{f}) / s{f} END, 6) AS {z}"
        for f, z in zip(FEATS, ZS)) + " FROM feat, st", "feat", "st")
SQL["neighbour_counts"] = with_ctes(
    "SELECT " + ", ".join(FEATS) + ", w, nbr_weight, core FROM vlab", "vlab")
SQL["dbscan_labels"] = with_ctes("SELECT event_id, cluster FROM lab", "lab")
SQL["cluster_totals"] = with_ctes(
    """SELECT count(*) AS total, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
  count(*) FILTER (WHERE cluster <> -1) AS clustered, count(*) FILTER (WHERE cluster = -1) AS noise
  FROM lab""", "lab")
SQL["cluster_profile"] = with_ctes(
    "SELECT cluster, size, round(error_rate, 9) AS error_rate, " + _join("names")
    + " AS event_names, n_event_names FROM prof", "prof")
SQL["cluster_names_limited"] = with_ctes(
    f"SELECT cluster, {_prefix_groups('names[1:2]')} AS names_shown, "
    "greatest(len(names) - 2, 0) AS more_names FROM prof", "prof")
SQL["top_clusters"] = with_ctes(
    "SELECT cluster, round(error_rate, 9) AS error_rate, size, rank FROM top", "top")
SQL["suspicious_events"] = with_ctes(
    "SELECT event_id, cluster FROM lab WHERE cluster IN (SELECT cluster FROM top)", "lab", "top")
SQL["suspicious_summary"] = with_ctes(
    """SELECT (SELECT string_agg(cluster::VARCHAR, ',' ORDER BY rank) FROM top) AS suspicious_clusters,
  count(*) FILTER (WHERE suspicious) AS suspicious_count, count(*) AS total_readonly,
  round(100.0::DOUBLE * count(*) FILTER (WHERE suspicious) / count(*), 1) AS suspicious_pct FROM flagged""",
    "flagged", "top")
SQL["minute_counts"] = with_ctes("SELECT minute, total, susp FROM e_min", "e_min")
SQL["minute_spine"] = with_ctes("SELECT minute, total, susp FROM e_dense", "e_dense")
SQL["rolling_density"] = with_ctes(
    "SELECT minute, roll_total::BIGINT AS roll_total, roll_susp::BIGINT AS roll_susp, "
    "round(density, 9) AS density FROM e_dens WHERE roll_total > 0", "e_dens")
SQL["error_timeframes"] = with_ctes(
    "SELECT tf_start, tf_end, round(confidence, 9) AS confidence FROM e_tf", "e_tf")
SQL["timeframes_stream"] = with_ctes(
    "SELECT tf_start, tf_end, round(confidence, 9) AS confidence FROM e_tf "
    "WHERE tf_end + INTERVAL 90 SECOND - INTERVAL 1 MICROSECOND <= "
    "(SELECT date_trunc('millisecond', max(eventTime)) FROM ro)", "e_tf", "ro")
SQL["timeframes"] = with_ctes(
    "SELECT tf_start, tf_end, round(confidence, 9) AS confidence FROM s_tf", "s_tf")
SQL["timeframes_5min_40pct"] = with_ctes(
    "SELECT tf_start, tf_end, round(confidence, 9) AS confidence FROM f_tf", "f_tf")
SQL["timeframe_identities"] = with_ctes("SELECT * FROM tfid", "tfid")
SQL["timeframe_identities_distinct"] = with_ctes(
    "SELECT tf_start, ip, iam, user_agent, os, count(*) AS n_events, min(ord) AS first_ord "
    "FROM tfid GROUP BY ALL", "tfid")
SQL["timeframe_apis"] = with_ctes(
    "SELECT tf_start, " + _join("apis") + " AS example_apis, n_identities FROM tfapi", "tfapi")
SQL["timeframe_report"] = with_ctes(
    """SELECT row_number() OVER (ORDER BY t.tf_start) AS ordinal,
  strftime(t.tf_start, '%Y-%m-%d %H:%M:%S') || ' UTC' AS period_start,
  strftime(t.tf_end, '%Y-%m-%d %H:%M:%S') || ' UTC' AS period_end,
  (epoch(t.tf_end) - epoch(t.tf_start))::BIGINT AS duration_seconds,
  round(t.confidence * 100, 1) AS confidence_pct,
  coalesce(len(a.apis), 0) AS n_apis,
  coalesce(""" + _prefix_groups("a.apis[1:15]") + """, '') AS apis_shown,
  coalesce(i.shown, '') AS identities_shown,
  coalesce(a.n_identities, 0) AS n_identities,
  greatest(coalesce(a.n_identities, 0) - 5, 0) AS more_identities
  FROM s_tf t LEFT JOIN tfapi a USING (tf_start)
  LEFT JOIN (SELECT tf_start, string_agg(ip || ' / ' || iam || ' / ' ||
      CASE WHEN starts_with(user_agent, '[') AND ends_with(user_agent, ']') AND length(user_agent) >= 2
           THEN substr(user_agent, 2, length(user_agent) - 2) ELSE user_agent END
      || ' / ' || os, ' || ' ORDER BY ord) AS shown
    FROM (SELECT * FROM tfid QUALIFY row_number() OVER (PARTITION BY tf_start ORDER BY ord) <= 5)
    GROUP BY tf_start) i USING (tf_start)""", "s_tf", "tfapi", "tfid")
SQL["clusters_json"] = with_ctes(
    "SELECT cluster AS cluster_id, size, round(error_rate, 9) AS error_rate, " + _join("names")
    + " AS event_names FROM prof", "prof")
SQL["clusters_document"] = SQL["clusters_json"]
SQL["suspicious_json"] = with_ctes(
    """SELECT (SELECT string_agg(cluster::VARCHAR, ',' ORDER BY rank) FROM top) AS suspicious_clusters,
  count(*) FILTER (WHERE suspicious) AS suspicious_count, count(*) AS total_readonly FROM flagged""",
    "flagged", "top")
SQL["timeframes_json"] = with_ctes(
    """SELECT strftime(t.tf_start, '%Y-%m-%dT%H:%M:%S') AS period_start,
  strftime(t.tf_end, '%Y-%m-%dT%H:%M:%S') AS period_end, round(t.confidence, 9) AS confidence,
  coalesce(i.part, 0) AS part, coalesce(i.shown, '') AS identities, coalesce(a.n_identities, 0) AS n_identities,
  CASE WHEN coalesce(i.part, 0) = 0 THEN coalesce(""" + _join("a.apis") + """, '') ELSE '' END AS example_apis
  FROM s_tf t LEFT JOIN tfapi a USING (tf_start)
  LEFT JOIN (SELECT tf_start, row_number() OVER (PARTITION BY tf_start ORDER BY share) - 1 AS part, shown FROM (
      SELECT tf_start, ord // 10000 AS share,
        string_agg(ip || ' / ' || iam || ' / ' || user_agent || ' / ' || os, ' || ' ORDER BY ord) AS shown
      FROM tfid GROUP BY ALL)) i USING (tf_start)""", "s_tf", "tfapi", "tfid")
SQL["timeframes_csv"] = (
    "SELECT ordinal, period_start, period_end, duration_seconds, confidence_pct, apis_shown, identities_shown, "
    "n_identities FROM (" + SQL["timeframe_report"] + ")")
SQL["sections_written"] = with_ctes(
    """SELECT 'clusters' AS section, cluster::VARCHAR AS name, size::BIGINT AS n FROM prof
  UNION ALL SELECT 'suspicious', (SELECT string_agg(cluster::VARCHAR, ',' ORDER BY rank) FROM top),
    count(*) FILTER (WHERE suspicious) FROM flagged
  UNION ALL SELECT 'timeframes', strftime(tf_start, '%Y-%m-%d %H:%M:%S') || ' UTC',
    (epoch(tf_end) - epoch(tf_start))::BIGINT FROM s_tf""", "prof", "top", "flagged", "s_tf")
SQL["empty_range"] = with_ctes(
    """SELECT unnest(['readonly', 'profile', 'chosen', 'timeframes', 'identities', 'apis', 'report']) AS result,
  (SELECT count(*) FROM audit WHERE eventTime >= TIMESTAMP '2100-01-01') AS n""", "audit")
SQL["names_by_prefix"] = with_ctes(
    "SELECT hour, " + _prefix_groups("names") + """ AS names_shown FROM (
  SELECT hour, list_sort(list(DISTINCT name)) AS names FROM (
    SELECT hour(eventTime)::INTEGER AS hour, unnest([eventSource, eventName]) AS name FROM audit)
  WHERE name IS NOT NULL GROUP BY hour)""", "audit")
SQL["timeframes_signature"] = with_ctes(
    "SELECT tf_start, tf_end, round(confidence, 9) AS confidence FROM g_tf", "g_tf")
SQL["distinct_apis_per_user"] = with_ctes(
    f"""SELECT cluster, count(*) AS n_users, round(avg(n_apis)::DOUBLE, 9) AS avg_distinct_apis FROM (
  SELECT cluster, {iam('userIdentity')} AS usr, count(DISTINCT coalesce(eventName, '')) AS n_apis
  FROM lab WHERE cluster <> -1 GROUP BY ALL) GROUP BY cluster""", "lab")
SQL["value_overlap"] = with_ctes(
    f"""SELECT cluster, round(avg(share) FILTER (WHERE kind = 'ip'), 9) AS ip_overlap,
  round(avg(share) FILTER (WHERE kind = 'ua'), 9) AS ua_overlap,
  round(avg(share) FILTER (WHERE kind = 'os'), 9) AS os_overlap FROM (
  SELECT t.cluster, t.usr, t.kind, avg(CASE WHEN s.n_clusters > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
  FROM (SELECT DISTINCT cluster, usr, kind, value FROM (
      SELECT cluster, {iam('userIdentity')} AS usr, 'ip' AS kind, coalesce(sourceIPAddress, '') AS value FROM lab
      UNION ALL SELECT cluster, {iam('userIdentity')}, 'ua', coalesce(userAgent, '') FROM lab
      UNION ALL SELECT cluster, {iam('userIdentity')}, 'os', {guess_os('userAgent')} FROM lab)) t
  JOIN (SELECT kind, value, count(DISTINCT cluster) AS n_clusters FROM (
      SELECT cluster, 'ip' AS kind, coalesce(sourceIPAddress, '') AS value FROM lab
      UNION ALL SELECT cluster, 'ua', coalesce(userAgent, '') FROM lab
      UNION ALL SELECT cluster, 'os', {guess_os('userAgent')} FROM lab) GROUP BY kind, value) s
  USING (kind, value)
  WHERE t.cluster <> -1 GROUP BY t.cluster, t.usr, t.kind) GROUP BY cluster""", "lab")


def _signature_values() -> str:
    rows = ", ".join(f"({_q(n)}, {_q(c)})" for c, names in SIGNATURES.items() for n in names)
    return f"(VALUES {rows}) AS sig(eventName, category)"


SQL["signature_match"] = with_ctes(
    f"SELECT a.event_id, a.eventName, sig.category FROM audit a JOIN {_signature_values()} "
    "USING (eventName)", "audit")
SQL["signature_frequency"] = with_ctes(
    f"SELECT sig.category, c.eventName, c.n FROM (SELECT eventName, count(*) AS n FROM audit "
    f"GROUP BY eventName) c JOIN {_signature_values()} USING (eventName)", "audit")
