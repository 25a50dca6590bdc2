"""DuckDB oracle SQL for every registered query.

Each statement recomputes the expected result from the *base* driver tables
(``events``, ``orders``, ...), never from the derived log text, so the
parsing done on the Spark side is really checked. Column names equal the
Spark query's; counts and sums are cast to BIGINT on both sides.
"""

from __future__ import annotations

START = "DATE '2024-01-10'"
END = "DATE '2024-01-17'"
START_TS = "TIMESTAMP '2024-01-10 00:00:00'"
END_TS = "TIMESTAMP '2024-01-17 00:00:00'"

EV_IP = "concat('10.0.', user_id % 4, '.', user_id)"
EV_RES = "concat('stack', (user_id // 10) % 9) AS stackName, concat('r', user_id // 10) AS stackResourceName, concat('bucket-', event_id % 3) AS source"

CDN = f"""cdn AS (
  SELECT CAST(ts AS DATE) AS date, {EV_IP} AS request_ip, event_type AS method,
         CASE WHEN event_id % 10 = 0 THEN 403 ELSE 200 END AS status,
         CASE WHEN event_id % 10 = 0 THEN 'GeoBlocked' END AS geoBlocked,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '/favicon.ico'
              WHEN event_id % 5 = 0 THEN '/index.html'
              ELSE concat('/', event_type, '/', event_id % 3) END AS uri,
         {EV_RES}
  FROM events)"""

CDN_AGG = f"""cdn_agg AS (
  SELECT stackName, stackResourceName, source, status, date, request_ip, geoBlocked, method,
         NULLIF(regexp_extract(uri, '^/?([^/]+)/', 1), '') AS uriRoot, count(*) AS count
  FROM cdn WHERE date BETWEEN {START} AND {END} AND uri <> '/favicon.ico'
  GROUP BY ALL)"""

OBJ = f"""obj AS (
  SELECT CASE WHEN event_id % 10 = 0 THEN '403' ELSE '200' END AS status,
         CAST(CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS DATE) AS date,
         concat('10.0.0.', user_id) AS request_ip, event_type AS method, {EV_RES}
  FROM events WHERE event_id % 3 = 0 AND event_id % 4 <> 1 AND event_id % 89 <> 0)"""

OBJ_AGG = f"""obj_agg AS (
  SELECT stackName, stackResourceName, source, status, date, request_ip, method, count(*) AS count
  FROM obj WHERE date BETWEEN {START} AND {END} GROUP BY ALL)"""

API = f"""api AS (
  SELECT ts AS timestamp, {EV_IP} AS sourceIp,
         CASE WHEN event_id % 9 = 0 THEN 'MESSAGE' WHEN event_type = 'signup' THEN 'CONNECTION_API'
              ELSE 'GET' END AS method,
         CASE WHEN event_id % 9 = 0 THEN '$default' ELSE concat('/', event_type) END AS path,
         concat('acct', event_id % 4) AS accountId, concat('/http/', user_id // 10, '/access') AS source
  FROM events WHERE event_id % 83 <> 0)"""

API_AGG = f"""api_agg AS (
  SELECT accountId, source, sourceIp, method, path, strftime(timestamp, '%Y-%m-%d') AS date,
         count(*) AS count
  FROM api WHERE timestamp >= {START_TS} AND timestamp <= {END_TS} AND method <> 'CONNECTION_API'
  GROUP BY ALL)"""

RTYPE = ("CASE WHEN p_size % 7 IN (0, 1) THEN 'CloudFront' WHEN p_size % 7 IN (2, 3) THEN 'S3AccessLogs' "
         "WHEN p_size % 7 IN (4, 5) THEN 'LogGroup' ELSE 'Unknown' END")

RES = f"""res AS (
  SELECT p_partkey, concat('acct', p_partkey % 4) AS accountId, concat('stack', (p_partkey // 2) % 9) AS stackName,
         concat('r', p_partkey // 2) AS name,
         CASE WHEN p_size % 7 IN (4, 5) THEN concat('/http/', p_partkey // 2, '/access') ELSE concat('bucket-', p_partkey % 3) END AS source,
         {RTYPE} AS type, CASE WHEN p_partkey % 2 = 0 THEN true END AS split
  FROM part WHERE concat('acct', p_partkey % 4) IN ('acct0', 'acct1', 'acct2'))"""

# Log groups not younger than the window's end; their retention always reaches it.
OPEN_GROUP = f"(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 23 AS INTEGER)) <= {END_TS})"

USAGE = f"""usage AS (
  SELECT r.accountId, c.stackName, c.stackResourceName, strftime(c.date, '%Y-%m-%d') AS date, c.count,
         concat(c.method, ' ', c.status) AS event, c.request_ip AS sourceIp, c.geoBlocked,
         CASE WHEN coalesce(r.split, false) THEN coalesce(c.uriRoot, '') END AS uriRoot
  FROM cdn_agg c JOIN res r ON r.stackName = c.stackName AND r.name = c.stackResourceName AND r.source = c.source AND r.type = 'CloudFront'
  UNION ALL
  SELECT r.accountId, o.stackName, o.stackResourceName, strftime(o.date, '%Y-%m-%d'), o.count,
         concat(o.method, ' ', o.status), o.request_ip, NULL, NULL
  FROM obj_agg o JOIN res r ON r.stackName = o.stackName AND r.name = o.stackResourceName AND r.source = o.source AND r.type = 'S3AccessLogs'
  UNION ALL
  SELECT r.accountId, r.stackName, r.name, a.date, a.count,
         concat(a.method, ' ', a.path), a.sourceIp, NULL, NULL
  FROM api_agg a JOIN res r ON r.accountId = a.accountId AND r.source = a.source AND r.type = 'LogGroup' AND {OPEN_GROUP})"""

USAGE_C = """usage_c AS (
  SELECT r.accountId, c.stackName, c.stackResourceName, strftime(c.date, '%Y-%m-%d') AS date, c.count,
         concat(c.method, ' ', c.status) AS event, c.request_ip AS sourceIp, c.geoBlocked,
         CASE WHEN coalesce(r.split, false) THEN coalesce(c.uriRoot, '') END AS uriRoot
  FROM cdn_agg c JOIN res r ON r.stackName = c.stackName AND r.name = c.stackResourceName AND r.source = c.source AND r.type = 'CloudFront')"""

IPINFO = f"""ipinfo AS (
  SELECT DISTINCT {EV_IP} AS ip, n.n_name AS country,
         CASE WHEN e.user_id % 30 = 24 THEN NULL ELSE concat('C', n.n_nationkey) END AS countryCode,
         r.r_name AS region, concat('City', e.user_id % 7) AS city,
         CASE WHEN e.user_id % 6 = 0 THEN concat('Org', e.user_id % 5)
              ELSE concat('AS', e.user_id, ' Org', e.user_id % 5) END AS org
  FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 30 JOIN region r ON r.r_regionkey = n.n_regionkey
  WHERE e.user_id % 30 < 25)"""

DIM = """dim AS (
  SELECT ip,
         CASE WHEN countryCode IN ('C1', 'C2') THEN 'high' WHEN countryCode IN ('C3', 'C4') THEN 'low'
              ELSE 'medium' END AS risk,
         concat(coalesce(country, 'undefined'), ' > ', coalesce(region, 'undefined'), ' > ',
                coalesce(city, 'undefined'), ' (', coalesce(org, 'undefined'), ')') AS description,
         concat(coalesce(country, 'undefined'), ' (', coalesce(org, 'undefined'), ')') AS shortDescription
  FROM ipinfo WHERE ip IN (SELECT sourceIp FROM usage))"""

ENRICHED = r"""enriched AS (
  SELECT u.*, coalesce(d.risk, 'unknown') AS risk, d.description, d.shortDescription,
         d.ip IS NOT NULL AS known,
         CASE WHEN d.ip IS NOT NULL THEN concat(d.risk, ' risk',
                CASE WHEN coalesce(u.geoBlocked, '') <> '' THEN concat(' (', u.geoBlocked, ')') ELSE '' END,
                ': ', regexp_replace(d.shortDescription, '^([^\(]+\()AS\d+ (.+\))$', '\1\2'))
              ELSE u.sourceIp END AS descriptor
  FROM usage u LEFT JOIN dim d ON d.ip = u.sourceIp)"""

ROLLUP = """rolled AS (
  SELECT concat_ws(' / ', accountId, stackName, stackResourceName, uriRoot) AS title, descriptor,
         CAST(sum(count) AS BIGINT) AS total
  FROM enriched GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


USAGE_CTES = (CDN, CDN_AGG, OBJ, OBJ_AGG, API, API_AGG, RES, USAGE)

# ------------------------------------------------------------------ logins

TRAIL = """trail AS (
  SELECT CAST(event_id AS VARCHAR) AS eventID, ts, user_id, event_id,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'CheckMfa'
              WHEN event_id % 2 = 0 THEN 'SwitchRole' ELSE 'ConsoleLogin' END AS eventName,
         CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'Failure' ELSE 'Success' END AS result,
         event_id % 13 = 3 AS no_resp,
         CASE WHEN event_type <> 'view' THEN 'signin.amazonaws.com' ELSE 'other' END AS eventSource,
         CASE WHEN event_type = 'error' THEN 'AwsApiCall' ELSE 'AwsConsoleSignIn' END AS eventType,
         CASE WHEN event_id % 23 = 0 THEN 'signin.amazonaws.com'
              WHEN event_id % 29 = 0 THEN concat('::ffff:10.0.0.', user_id)
              WHEN event_id % 31 = 0 THEN concat('2001:db8::', user_id)
              ELSE concat('10.0.', user_id % 3, '.', user_id) END AS sourceIPAddress,
         CASE WHEN event_id % 23 = 0 THEN false
              WHEN event_id % 29 = 0 THEN user_id <= 255
              WHEN event_id % 31 = 0 THEN user_id <= 9
              ELSE user_id % 3 = 0 AND user_id <= 255 END AS allowed,
         event_id % 17 = 0 AS no_ident, event_id % 19 = 0 AS no_extra,
         CASE WHEN user_id % 2 = 0 THEN 'IAMUser' ELSE 'AssumedRole' END AS utype,
         concat('arn:aws:iam::', user_id) AS uarn, concat('arn:from:', user_id) AS switch_from,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS eventTime, concat('agent-', event_type) AS userAgent,
         concat('acct', user_id % 4) AS recipientAccountId
  FROM events),
trail2 AS (
  SELECT *,
         CASE WHEN no_resp THEN NULL WHEN coalesce(eventName = 'SwitchRole', false) THEN NULL ELSE result END AS consoleLogin,
         CASE WHEN no_resp THEN NULL WHEN coalesce(eventName = 'SwitchRole', false) THEN result ELSE NULL END AS switchRole
  FROM trail),
signin AS (
  SELECT * FROM trail2
  WHERE eventSource = 'signin.amazonaws.com' AND eventType = 'AwsConsoleSignIn'
    AND eventName IS DISTINCT FROM 'CheckMfa'
    AND coalesce(consoleLogin, 'Success') = 'Success' AND coalesce(switchRole, 'Success') = 'Success')"""

# ------------------------------------------------------------------ credentials

def cred_cte(name: str, now: str, mfa_above: int) -> str:
    return f"""{name}_rep AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS accountId, c.c_custkey AS k,
         CASE WHEN c.c_custkey % 50 = 0 THEN '<root_account>' ELSE c.c_name END AS "user",
         concat('arn:', c.c_custkey) AS arn,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS password_enabled,
         CASE WHEN c.c_acctbal > {mfa_above} THEN 'true' ELSE 'false' END AS mfa_active,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS k1,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS k2,
         CAST(floor(date_diff('second', l.latest, TIMESTAMP '{now}') / 86400.0 + 0.5) AS BIGINT) AS age
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY 1) l
       ON l.o_custkey = c.c_custkey),
{name} AS (
  SELECT n.accountId, 'rootUsers' AS resource, 'length' AS attribute, '> 0' AS expected,
         CAST(coalesce(r.n_root, 0) AS VARCHAR) AS actual
  FROM (SELECT CAST(n_nationkey AS VARCHAR) AS accountId FROM nation) n
  LEFT JOIN (SELECT accountId, count(*) FILTER (WHERE "user" = '<root_account>') AS n_root
             FROM {name}_rep GROUP BY 1) r ON r.accountId = n.accountId
  WHERE coalesce(r.n_root, 0) = 0
  UNION ALL SELECT accountId, arn, 'access_key_1_active', 'false', k1 FROM {name}_rep
    WHERE "user" = '<root_account>' AND k1 <> 'false'
  UNION ALL SELECT accountId, arn, 'access_key_2_active', 'false', k2 FROM {name}_rep
    WHERE "user" = '<root_account>' AND k2 <> 'false'
  UNION ALL SELECT accountId, arn, 'mfa_active', 'true', mfa_active FROM {name}_rep
    WHERE "user" = '<root_account>' AND mfa_active <> 'true'
  UNION ALL SELECT accountId, arn, 'mfa_active', 'true', mfa_active FROM {name}_rep
    WHERE "user" <> '<root_account>' AND password_enabled = 'true' AND mfa_active <> 'true'
  UNION ALL SELECT accountId, arn, 'password_last_changed', 'less than 90 days ago', coalesce(CAST(age AS VARCHAR), 'NaN')
    FROM {name}_rep WHERE "user" <> '<root_account>' AND password_enabled = 'true' AND (age IS NULL OR age >= 90)
  UNION ALL SELECT accountId, arn, 'access_key_1_last_rotated', 'less than 90 days ago', coalesce(CAST(age AS VARCHAR), 'NaN')
    FROM {name}_rep WHERE "user" <> '<root_account>' AND k1 = 'true' AND (age IS NULL OR age >= 90)
  UNION ALL SELECT accountId, arn, 'access_key_2_last_rotated', 'less than 90 days ago', coalesce(CAST(age AS VARCHAR), 'NaN')
    FROM {name}_rep WHERE "user" <> '<root_account>' AND k2 = 'true' AND (age IS NULL OR age >= 90)),
{name}_k AS (
  SELECT *, concat_ws('-', accountId, resource, attribute, expected) AS pk,
         format('{{}}: {{}}.{{}} should be ''{{}}'' but was ''{{}}''', accountId, resource, attribute, expected, actual) AS text,
         to_json(struct_pack(accountId := accountId, resource := resource, attribute := attribute,
                             expected := expected, actual := actual)) AS obj
  FROM {name})"""


CUR = cred_cte("cur", "2001-08-02 00:00:00", 5000)
PREV = cred_cte("prev", "2001-06-01 00:00:00", 3000)
STATES = """states AS (
  SELECT 'raised' AS state, pk, text, obj FROM cur_k WHERE pk NOT IN (SELECT pk FROM prev_k)
  UNION ALL SELECT 'existing', pk, text, obj FROM cur_k WHERE pk IN (SELECT pk FROM prev_k)
  UNION ALL SELECT 'fixed', pk, text, obj FROM prev_k WHERE pk NOT IN (SELECT pk FROM cur_k))"""

# ------------------------------------------------------------------ drift

DRIFT = r"""li AS (
  SELECT l_orderkey AS stackKey,
         CASE WHEN l_linenumber = 7 THEN true ELSE coalesce(
           (CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'null' ELSE 'x' END) = 'null' AND (
             (l_linenumber % 4 = 0)
             OR (l_returnflag = 'R' AND l_linenumber % 4 = 1)
             OR (l_returnflag = 'A' AND l_linenumber % 4 = 3)
             OR (l_returnflag NOT IN ('A', 'R') AND l_linenumber % 4 = 2)
           ), false) END AS ok
  FROM lineitem),
acc AS (SELECT stackKey, bool_and(ok) AS acceptable FROM li GROUP BY 1),
st AS (
  SELECT o_orderkey AS stackKey, o_orderpriority AS accountId, concat('stack', o_orderkey) AS stackName,
         CASE WHEN o_orderkey % 13 = 0 THEN 'DELETE_COMPLETE' WHEN o_orderkey % 17 = 0 THEN 'ROLLBACK_COMPLETE'
              WHEN o_orderkey % 19 = 0 THEN 'IMPORT_COMPLETE' ELSE 'UPDATE_COMPLETE' END AS StackStatus,
         CASE WHEN o_orderkey % 23 = 0 THEN 'NOT_CHECKED' WHEN o_orderstatus = 'F' THEN 'DRIFTED'
              WHEN o_orderstatus = 'O' THEN 'UNKNOWN' ELSE 'IN_SYNC' END AS detectedStatus
  FROM orders),
ds AS (
  SELECT st.accountId, st.stackName, st.detectedStatus, coalesce(acc.acceptable, true) AS acceptable,
         CASE WHEN st.detectedStatus IN ('DRIFTED', 'UNKNOWN') AND coalesce(acc.acceptable, true) THEN 'IN_SYNC'
              ELSE st.detectedStatus END AS driftStatus
  FROM st LEFT JOIN acc ON acc.stackKey = st.stackKey
  WHERE st.StackStatus NOT IN ('ROLLBACK_COMPLETE', 'ROLLBACK_FAILED', 'ROLLBACK_IN_PROGRESS',
        'CREATE_IN_PROGRESS', 'CREATE_FAILED', 'DELETE_COMPLETE', 'DELETE_FAILED', 'DELETE_IN_PROGRESS'))"""

# ------------------------------------------------------------------ pages

PAGES = """pp AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '[?#].*$', '') AS path FROM pages),
remote AS (SELECT DISTINCT path FROM (SELECT CASE WHEN page_id % 4 = 0 THEN concat('old/', path) ELSE path END AS path FROM pp) WHERE NOT suffix(path, '.html')),
localp AS (SELECT DISTINCT path FROM (SELECT CASE WHEN page_id % 3 = 0 THEN concat('new/', path) ELSE path END AS path FROM pp) WHERE NOT suffix(path, '.html')),
diff AS (
  SELECT coalesce(r.path, l.path) AS path,
         CASE WHEN r.path IS NOT NULL AND l.path IS NOT NULL THEN 'ignore'
              WHEN l.path IS NOT NULL THEN 'upload'
              WHEN r.path <> 'index.html' THEN 'delete' END AS action
  FROM remote r FULL OUTER JOIN localp l ON r.path = l.path)"""

TREE = """keys AS (
  SELECT DISTINCT path AS key FROM (SELECT CASE WHEN page_id % 4 = 0 THEN concat('old/', path) ELSE path END AS path FROM pp) WHERE NOT suffix(path, 'index.html')),
kp AS (SELECT key, string_split(key, '/') AS p FROM keys),
entries AS (
  SELECT DISTINCT p[1:i] AS pp2, 'folder' AS kind FROM (SELECT p, unnest(range(1, len(p))) AS i FROM kp)
  UNION ALL SELECT p, 'file' FROM kp)"""

# ------------------------------------------------------------------ part templates

TPL = """tpl AS (
  SELECT p_brand AS template, concat('Res', p_partkey) AS logicalId, p_partkey AS k, p_size AS sz, p_name,
         CASE p_partkey % 4 WHEN 0 THEN 'AWS::S3::Bucket' WHEN 1 THEN 'AWS::IAM::ManagedPolicy'
              WHEN 2 THEN 'AWS::SecretsManager::Secret' ELSE 'AWS::Lambda::Function' END AS Type,
         CASE p_size % 3 WHEN 1 THEN 'Delete' WHEN 2 THEN 'Retain' END AS DeletionPolicy,
         CASE p_size % 4 WHEN 1 THEN 'Delete' WHEN 2 THEN 'Snapshot' END AS UpdateReplacePolicy
  FROM part)"""


def _q(body: str, *ctes: str) -> str:
    return (with_(*ctes) if ctes else "") + body


ORACLE: dict[str, str] = {
    "cdn_usage": _q(f"""SELECT status, date, request_ip, geoBlocked, method,
       NULLIF(regexp_extract(uri, '^/?([^/]+)/', 1), '') AS uriRoot, count(*) AS count
FROM cdn WHERE date BETWEEN {START} AND {END} AND uri <> '/favicon.ico' GROUP BY ALL""", CDN),

    "object_usage": _q(f"""SELECT status, date, request_ip, method, count(*) AS count
FROM obj WHERE date BETWEEN {START} AND {END} GROUP BY ALL""", OBJ),

    "api_usage": _q(f"""SELECT sourceIp, method, path, strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS count
FROM api WHERE timestamp >= {START_TS} AND timestamp <= {END_TS} AND method <> 'CONNECTION_API'
GROUP BY ALL""", API),

    "usage_all": _q("SELECT * FROM usage", *USAGE_CTES),

    "ip_risk": _q("""SELECT i.sourceIp AS ip, coalesce(d.risk, 'unknown') AS risk, d.description, d.shortDescription,
       d.ip IS NOT NULL AS known
FROM (SELECT DISTINCT sourceIp FROM usage) i LEFT JOIN dim d ON d.ip = i.sourceIp""", *USAGE_CTES, IPINFO, DIM),

    "usage_rollup": _q("SELECT * FROM rolled", *USAGE_CTES, IPINFO, DIM, ENRICHED, ROLLUP),

    "usage_report": _q("""SELECT 0 AS section, '' AS title, 0 AS kind, 'Usage info for the past 7 days:' AS line
UNION ALL SELECT 1, '', 0, concat(ip, ': ', description, ' (', risk, ' risk)') FROM dim
UNION ALL SELECT DISTINCT 2, title, 0, title FROM rolled
UNION ALL SELECT 2, title, 1, concat(descriptor, ': ', total) FROM rolled
UNION ALL SELECT 3, '', 0, concat('errors: {"name":"', name, '","source":"', source, '","type":"', type, '"',
       CASE WHEN split THEN ',"splitReportingByUrlRoot":true' ELSE '' END, '}')
  FROM res WHERE type NOT IN ('CloudFront', 'S3AccessLogs', 'LogGroup')
UNION ALL SELECT 4, '', 0, 'No usage found.' FROM (SELECT count(*) AS n FROM enriched) WHERE n = 0""",
                       *USAGE_CTES, IPINFO, DIM, ENRICHED, ROLLUP),

    "usage_detail": _q("""SELECT concat(accountId, '/', stackName, '/', stackResourceName, ' ', date, ' (', count, '): ',
       event, ', ', sourceIp, ' (', risk, ' ip risk',
       CASE WHEN coalesce(geoBlocked, '') <> '' THEN concat(', ', geoBlocked) ELSE '' END, ')') AS line
FROM enriched""", *USAGE_CTES, IPINFO, DIM, ENRICHED),

    "tracked_resources": f"""SELECT o_orderpriority AS accountId, concat('stack', o_orderkey) AS stackName,
       concat('r', p_partkey) AS name, concat('bucket-', p_partkey % 5) AS source, {RTYPE} AS type,
       CASE WHEN p_partkey % 2 = 0 THEN true END AS splitReportingByUrlRoot,
       CASE WHEN {RTYPE} = 'Unknown' THEN 'error' ELSE {RTYPE} END AS route,
       CASE WHEN {RTYPE} IN ('CloudFront', 'S3AccessLogs') THEN regexp_replace(lower(concat(
            CASE WHEN {RTYPE} = 'CloudFront' THEN 'cloudfrontlogs' ELSE 's3accesslogs' END,
            '_stack', o_orderkey, '_r', p_partkey)), '[^a-z_0-9]', '__', 'g') END AS table_name
FROM orders JOIN part ON p_partkey = o_custkey
WHERE o_orderkey % 5 <> 0 AND p_partkey % 3 = 0""",

    "log_range_guard": """SELECT logGroupName, count(*) AS n_groups,
       count(*) = 1 AND bool_and(coalesce(TIMESTAMP '1998-06-01 00:00:00' >= creationTime AND (retention IS NULL OR
         TIMESTAMP '1998-06-01 00:00:00' >= TIMESTAMP '1998-06-01 06:00:00' - to_days(CAST(retention AS INTEGER))), false)) AS in_range
FROM (SELECT CASE WHEN o_orderkey % 50 = 1 THEN concat('lg', o_orderkey - 1) ELSE concat('lg', o_orderkey) END AS logGroupName,
             o_orderdate AS creationTime,
             CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 1000 END AS retention FROM orders)
GROUP BY 1""",

    "usage_by_source": _q("""SELECT accountId, stackName, stackResourceName, date, count, event, sourceIp, geoBlocked, uriRoot FROM usage_c""",
                          CDN, CDN_AGG, RES, USAGE_C),

    "log_group_errors": f"""WITH wanted AS (SELECT DISTINCT concat('acct', p_partkey % 4) AS accountId, p_partkey // 2 AS k
  FROM part WHERE {RTYPE} = 'LogGroup')
SELECT accountId, concat('/http/', k, '/access') AS source, n::BIGINT AS n_groups,
       format('{{}} log groups named ''/http/{{}}/access'' in account {{}}, one expected', n, k, accountId) AS error
FROM (SELECT *, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 2 ELSE 1 END AS n FROM wanted) WHERE n <> 1""",

    "location_errors": f"""SELECT type, location, n_resources, format('{{}} resources keep their logs at ''{{}}''', n_resources, location) AS error
FROM (SELECT {RTYPE} AS type, concat('bucket-', p_partkey % 2, '/stack', p_partkey % 9, '/r', p_partkey // 90) AS location,
             count(*) AS n_resources FROM part WHERE {RTYPE} IN ('CloudFront', 'S3AccessLogs') GROUP BY ALL)
WHERE n_resources > 1""",

    "login_filter": _q("""SELECT eventID, eventName, sourceIPAddress, eventSource, eventType, consoleLogin, switchRole
FROM signin""", TRAIL),

    "login_alerts": _q("""SELECT eventID,
       CASE WHEN no_ident THEN '[unknown] - [unknown]' ELSE concat(utype, ' - ', uarn) END
         || CASE WHEN eventName = 'SwitchRole' THEN concat(' from ', CASE WHEN no_extra THEN '[unknown]' ELSE switch_from END)
                 ELSE '' END AS "user",
       eventTime AS time, sourceIPAddress AS sourceIp, userAgent, recipientAccountId AS account,
       eventSource, eventType, eventName, consoleLogin, switchRole
FROM signin WHERE NOT allowed""", TRAIL),

    "cred_rules": _q("SELECT accountId, resource, attribute, expected, actual, pk, text FROM cur_k", CUR),

    "drift_status": _q("""SELECT accountId, stackName, detectedStatus, acceptable, driftStatus,
       driftStatus IS DISTINCT FROM 'IN_SYNC' AS is_issue, concat_ws('-', accountId, stackName) AS pk,
       format('{}: {} is ''{}''', accountId, stackName, coalesce(driftStatus, 'null')) AS text
FROM ds""", DRIFT),

    "device_issues": """SELECT concat('thing', s_suppkey) AS thingName, concat('id', s_suppkey) AS thingId,
       false AS connected,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1700000000000 + s_suppkey * 1000 END AS timestamp,
       concat('thing', s_suppkey) AS pk,
       concat('thing', s_suppkey, ' (id', s_suppkey, ') was disconnected since ',
              CASE WHEN s_suppkey % 7 = 0 THEN '[unknown]'
                   ELSE strftime(epoch_ms(1700000000000 + s_suppkey * 1000), '%a %b %d %Y %H:%M:%S')
                        || ' GMT+0000 (Coordinated Universal Time)' END, '''') AS text
FROM supplier WHERE NOT (s_acctbal > 1000) AND s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0""",

    "device_latest": """SELECT user_id AS thing, arg_max(event_type IN ('click', 'view', 'signup'), (ts, event_id)) AS connected,
       max(ts) AS last_ts, count(*) AS n_events
FROM events GROUP BY user_id""",

    "issue_states": _q("SELECT state, pk, text FROM states", CUR, PREV, STATES),

    "issue_snapshot": _q("""SELECT 'iam-checker' AS monitor, pk, obj FROM prev_k WHERE pk IN (SELECT pk FROM cur_k)
UNION ALL SELECT 'iam-checker', pk, min(obj) FROM cur_k WHERE pk NOT IN (SELECT pk FROM prev_k) GROUP BY pk""",
                         CUR, PREV),

    "issue_message": _q("""SELECT 0 AS section, 0 AS kind, 'IAM issues found.' AS line
UNION ALL SELECT h.ord, 0, CASE WHEN coalesce(c.n, 0) > 0 THEN concat(h.heading, ':') ELSE concat('No ', h.heading, '.') END
FROM (VALUES ('raised', 1, 'newly raised issues'), ('existing', 2, 'previously raised issues'),
             ('fixed', 3, 'issues resolved')) h(state, ord, heading)
LEFT JOIN (SELECT state, count(*) AS n FROM states GROUP BY 1) c ON c.state = h.state
UNION ALL SELECT CASE state WHEN 'raised' THEN 1 WHEN 'existing' THEN 2 ELSE 3 END, 1, text FROM states""",
                        CUR, PREV, STATES),

    "issue_notify": _q("""SELECT CAST(count(*) FILTER (WHERE state = 'raised') AS BIGINT) AS raised,
       CAST(count(*) FILTER (WHERE state = 'existing') AS BIGINT) AS existing,
       CAST(count(*) FILTER (WHERE state = 'fixed') AS BIGINT) AS fixed,
       count(*) FILTER (WHERE state = 'raised') > 0 OR count(*) FILTER (WHERE state = 'fixed') > 0
         OR (count(*) FILTER (WHERE state = 'existing') > 0 AND dayofweek(DATE '2001-08-02') = 1) AS notify
FROM states""", CUR, PREV, STATES),

    "inventory_diff": _q("SELECT path, action FROM diff WHERE action IS NOT NULL", PAGES),

    "inventory_counts": _q("SELECT action, count(*) AS n FROM diff WHERE action IS NOT NULL GROUP BY 1", PAGES),

    "key_tree": _q("""SELECT array_to_string(pp2, '/') AS path, pp2[len(pp2)] AS name, len(pp2) - 1 AS depth, kind
FROM entries""", PAGES, TREE),

    "template_policies": _q("""SELECT template, logicalId AS resource, 'DeletionPolicy' AS attribute, 'Delete' AS expected,
       DeletionPolicy AS actual FROM tpl WHERE DeletionPolicy IS NOT NULL AND DeletionPolicy <> 'Delete'
UNION ALL SELECT template, logicalId, 'UpdateReplacePolicy', 'Delete', UpdateReplacePolicy FROM tpl
  WHERE UpdateReplacePolicy IS NOT NULL AND UpdateReplacePolicy <> 'Delete'
UNION ALL SELECT template, logicalId, 'Description', '.+',
       CASE WHEN sz % 5 = 0 THEN '' WHEN sz % 5 = 1 THEN NULL ELSE concat('policy ', k) END
  FROM tpl WHERE Type = 'AWS::IAM::ManagedPolicy' AND sz % 5 IN (0, 1)
UNION ALL SELECT template, logicalId, 'SSEAlgorithm', 'AES256',
       CASE WHEN sz > 10 THEN concat('[{"ServerSideEncryptionByDefault":{"SSEAlgorithm":"', 'aws:kms', '"}}]') END
  FROM tpl WHERE Type = 'AWS::S3::Bucket' AND (sz <= 10 OR sz > 40)
UNION ALL SELECT template, NULL, 'AWS::SecretsManager::Secret', '0', CAST(count(*) AS VARCHAR)
  FROM tpl WHERE Type = 'AWS::SecretsManager::Secret' GROUP BY template""", TPL),

    "asset_counts": _q("""SELECT t.template, CAST(coalesce(a.n, 0) AS BIGINT) AS n_assets, CAST(3 AS BIGINT) AS expected,
       coalesce(a.n, 0) = 3 AS ok
FROM (SELECT DISTINCT template FROM tpl) t
LEFT JOIN (SELECT template, count(*) AS n FROM tpl
           WHERE Type = 'AWS::Lambda::Function' AND sz % 9 <> 0 AND sz % 11 <> 0 GROUP BY 1) a
  ON a.template = t.template""", TPL),

    "unique_lookup": _q("""SELECT l.template, l.path, CAST(count(t.logicalId) AS BIGINT) AS n_matches,
       CASE WHEN count(t.logicalId) = 1 THEN min(t.logicalId) END AS logicalId,
       CASE WHEN count(t.logicalId) = 1 AND min(t.k) % 7 <> 0 THEN min(concat('phys-', t.k)) END AS physicalId,
       CASE WHEN count(t.logicalId) = 0 THEN format('Nothing in the template has the path ''{}''', l.path)
            WHEN count(t.logicalId) > 1 THEN format('{} logical ids have the path ''{}''', count(t.logicalId), l.path)
            WHEN min(t.k) % 7 = 0 THEN format('Logical id ''{}'' has no physical id', min(t.logicalId)) END AS error
FROM (SELECT DISTINCT p_brand AS template, concat(p_brand, '/', p_name, CASE WHEN p_partkey % 10 = 1 THEN '-missing' ELSE '' END) AS path FROM part) l
LEFT JOIN tpl t ON t.template = l.template AND concat(t.template, '/', t.p_name) = l.path
GROUP BY l.template, l.path""", TPL),

    "deployed_stacks": """SELECT profile, stackName, concat('AWS_PROFILE=', profile, ' npx cdk diff --strict --fail ', stackName) AS command
FROM (SELECT concat(lower(replace(o_orderpriority, ' ', '')),
                    CASE WHEN o_orderkey % 2 = 0 THEN '-developer' ELSE '-admin' END) AS profile,
             CASE WHEN o_orderkey % 1000 = 0 THEN 'CDKToolkit' ELSE concat('stack', o_orderkey) END AS stackName,
             o_orderstatus FROM orders)
WHERE o_orderstatus <> 'O' AND stackName <> 'CDKToolkit' AND suffix(profile, '-developer')""",

    "teardown_split": """SELECT CASE WHEN o_orderkey % 1000 = 0 THEN 'CDKToolkit' ELSE concat('stack', o_orderkey) END AS StackName,
       o_orderkey % 4 = 0 OR o_orderkey % 1000 = 0 AS protected
FROM orders""",

    "teardown_tally": """SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 1000 = 0 THEN 'skipped'
              WHEN o_orderstatus = 'F' THEN 'destroyed' ELSE 'failed' END AS outcome FROM orders)
GROUP BY 1""",

    "budget_alerts": """SELECT m.month, m.cost_cents, t.budget, t.pct, t.limit_cents
FROM (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost_cents
      FROM orders GROUP BY 1) m,
     (VALUES ('warning', 5, CAST(5000000000 AS BIGINT)), ('warning', 100, CAST(5000000000 AS BIGINT)),
             ('maximum', 100, CAST(6000000000 AS BIGINT))) t(budget, pct, limit_cents)
WHERE m.cost_cents * 100 > t.limit_cents * t.pct""",

    "upload_manifest": """SELECT request_id, errors IS NULL AS valid, errors,
       CASE WHEN errors IS NULL THEN concat('uploads/', prefix, enc, '-', request_id) END AS key,
       CASE WHEN errors IS NULL THEN '2024-01-17 12:05:00' END AS put_expires,
       CASE WHEN errors IS NULL THEN '2024-01-19 12:00:00' END AS get_expires
FROM (SELECT CAST(doc_id AS VARCHAR) AS request_id,
             CASE WHEN doc_id % 13 = 0 THEN NULL ELSE replace(concat(source, ' ', doc_id, '.txt'), ' ', '20') END AS enc,
             CASE WHEN doc_id % 3 = 2 THEN concat(lang, '/') ELSE '' END AS prefix,
             NULLIF(concat_ws('; ',
               CASE WHEN doc_id % 13 = 0 THEN 'parameter ''fileName'' must be specified and non-empty string' END,
               CASE WHEN doc_id % 3 = 1 THEN 'if specified, parameter ''prefixes'' must be a non-zero length array' END),
               '') AS errors
      FROM documents)""",

    "field_rows": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS type,
       CAST(user_id AS VARCHAR) AS "user"
FROM events""",
}

# The stream over two file drops must equal the batch alerts.
ORACLE["login_stream"] = ORACLE["login_alerts"]
# The device-state stream's final state must equal the batch latest state.
ORACLE["device_stream"] = ORACLE["device_latest"]
# The file-based variants read what the shims wrote: same expected rows.
ORACLE["usage_landed"] = ORACLE["usage_by_source"]
ORACLE["report_ordered"] = f"""SELECT *, row_number() OVER (ORDER BY section, title, kind, line) AS line_number FROM ({ORACLE["usage_report"]})"""
ORACLE["report_written"] = f"""SELECT line FROM ({ORACLE["usage_report"]})"""
ORACLE["api_usage_files"] = ORACLE["api_usage"]
ORACLE["account_check"] = f"""SELECT accountId, attribute, count(*) AS n FROM ({ORACLE["cred_rules"]})
WHERE CAST(accountId AS INTEGER) % 2 = 0 GROUP BY ALL"""
# Entries by level: names that read as array indices first, by number, then the others, folders with a slash.
ORACLE["key_listing"] = _q("""SELECT row_number() OVER (ORDER BY ord, kind) AS position, array_to_string(pp2, '/') AS path, pp2[len(pp2)] AS name,
       len(pp2) - 1 AS depth, kind,
       CASE WHEN kind = 'file' THEN 1 ELSE (SELECT count(*) FROM kp WHERE len(p) > len(pp2) AND p[1:len(pp2)] = pp2) END AS n_files,
       CASE WHEN kind = 'file' THEN concat('<a href="/site/', array_to_string(pp2, '/'), '">', pp2[len(pp2)], '</a>') END AS link
FROM (SELECT *, list_transform(pp2, lambda x, i: {
        'a': CASE WHEN regexp_full_match(x, '(0|[1-9][0-9]{0,9})') AND TRY_CAST(x AS BIGINT) < 4294967295 THEN 0 ELSE 1 END,
        'b': CASE WHEN regexp_full_match(x, '(0|[1-9][0-9]{0,9})') AND TRY_CAST(x AS BIGINT) < 4294967295 THEN TRY_CAST(x AS BIGINT) ELSE 0 END,
        'c': concat(x, CASE WHEN i < len(pp2) OR kind = 'folder' THEN '/' ELSE '' END)}) AS ord FROM entries)""", PAGES, TREE)
ORACLE["issue_lifecycle_stored"] = ORACLE["issue_states"]
ORACLE["store_round_trip"] = ORACLE["issue_snapshot"]
ORACLE["login_messages"] = _q("""SELECT event_id // 250 AS doc, 'AWS account login alert' AS subject, count(*) AS n_alerts
FROM signin WHERE NOT allowed GROUP BY ALL""", TRAIL)
ORACLE["cdn_usage_files"] = ORACLE["cdn_usage"]
ORACLE["object_usage_files"] = ORACLE["object_usage"]
ORACLE["login_alerts_files"] = ORACLE["login_alerts"]
ORACLE["cred_rules_files"] = ORACLE["cred_rules"]
ORACLE["drift_status_files"] = ORACLE["drift_status"]
ORACLE["device_issues_files"] = ORACLE["device_issues"]
