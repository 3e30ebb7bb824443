"""The queries in standard SQL over the same tables, for an independent engine."""

NOW = 1_706_572_800_000
DAY = 86_400_000
TRIGGER = DAY // 4


def vin(number: str) -> str:
    serial = f"cast(102301 + {number} as varchar)"
    return (
        f"concat(left('7H4T9K2L5RA', least(11, 17 - length({serial}))), "
        f"lpad({serial}, greatest(6, length({serial})::int)::int, '0'))"
    )


def lost_vin(number: str) -> str:
    return f"concat('0L0ST', lpad(cast({number} as varchar), 12, '0'))"


COMMON = f"""
WITH ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms,
         cast(json_extract_string(props, '$.k') as bigint) AS k
  FROM events
), copies AS (
  SELECT *, 0 AS rep FROM ev UNION ALL SELECT *, 1 AS rep FROM ev WHERE event_id % 33 = 0
), raw AS (
  SELECT cast(user_id % 6 as integer) AS "partition", event_id * 2 + rep AS "offset",
    CASE WHEN event_id % 211 = 5 THEN 'BADVIN' ELSE {vin('user_id')} END AS vin,
    cast(-122.4194 as double) + cast(user_id % 100 - 50 as double) * cast(0.0012 as double) AS lng,
    CASE WHEN event_id % 307 = 7 THEN cast(95 as double)
         ELSE cast(37.7749 as double) + cast(k - 50 as double) * cast(0.0012 as double) END AS lat,
    cast(CASE WHEN event_id % 503 = 3 THEN 0 WHEN event_id % 509 = 4 THEN 7
         WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2
         WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'signup' THEN 4
         ELSE 5 END as integer) AS status_code,
    cast(cast(value as float) as double) AS battery_soc,
    CASE WHEN event_id % 401 = 9 THEN 0 ELSE ms END AS device_timestamp,
    ms + 100 + k * 10 + rep * 500 AS record_ts,
    CASE WHEN event_id % 97 = 1 THEN ms + 100 + k * 10 + rep * 500
         ELSE ms + 95 + k * 10 + rep * 500 END AS ingest_timestamp
  FROM copies
), checked AS (
  SELECT *, CASE
    WHEN octet_length(encode(vin)) <> 17 THEN concat('validate: invalid VIN "', vin, '"')
    WHEN lat < -90 OR lat > 90 OR lng < -180 OR lng > 180 THEN 'validate: coordinates out of range'
    WHEN battery_soc < 0 OR battery_soc > 100 THEN 'validate: batterySOC out of range'
    WHEN device_timestamp <= 0 THEN 'validate: missing deviceTimestamp'
    WHEN device_timestamp > {NOW} + 300000 THEN 'validate: deviceTimestamp in the future'
    END AS error
  FROM raw
), firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY vin, device_timestamp ORDER BY "partition", "offset") AS rn
    FROM checked WHERE error IS NULL) WHERE rn = 1
), seen AS (
  SELECT DISTINCT vin, device_timestamp FROM checked
  WHERE error IS NULL AND ("offset" // 2) % 5 = 0
), nation_fleet AS (
  SELECT n_nationkey, n_name, concat('fleet-', lower(n_name)) AS fleet_id FROM nation
), fleets AS (
  SELECT fleet_id, n_name AS name, cast(0 as bigint) AS created_at FROM nation_fleet
), cust AS (
  SELECT c_custkey, {vin('c_custkey')} AS vin,
    CASE WHEN c_custkey % 10 <> 9 THEN fleet_id END AS fleet_id, c_mktsegment AS model
  FROM customer JOIN nation_fleet ON c_nationkey = n_nationkey
), vehicles AS (
  SELECT vin, fleet_id, model, cast(0 as bigint) AS updated_at FROM cust
), vehicle_fleet AS (
  SELECT vin, fleet_id FROM vehicles WHERE fleet_id IS NOT NULL
), users AS (
  SELECT concat('u-', s_suppkey) AS user_id, concat('u-', s_suppkey) AS username,
    s_name AS display_name,
    CASE WHEN s_suppkey % 10 = 0 THEN 'admin'
         WHEN s_suppkey % 10 <= 4 THEN 'fleet_manager' ELSE 'viewer' END AS role,
    cast(0 as bigint) AS created_at
  FROM supplier
), fleet_grants AS (
  SELECT concat('u-', s_suppkey) AS user_id, fleet_id
  FROM supplier JOIN nation_fleet ON s_nationkey = n_nationkey WHERE s_suppkey % 10 BETWEEN 1 AND 6
  UNION
  SELECT concat('u-', s_suppkey), fleet_id
  FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN nation_fleet ON c_nationkey = n_nationkey
  WHERE s_suppkey % 10 = 5
), vehicle_grants AS (
  SELECT concat('u-', s_suppkey) AS user_id, {vin('s_suppkey')} AS vin
  FROM supplier WHERE s_suppkey % 10 BETWEEN 5 AND 8
), connections AS (
  SELECT concat('pod-', s_suppkey % 4) AS pod, concat('u-', s_suppkey) AS user_id, s_suppkey
  FROM supplier
), canonical AS (
  SELECT concat(f.vin, '-', f.device_timestamp) AS event_id, cast(1 as integer) AS schema_version,
    f.vin, coalesce(v.fleet_id, 'UNASSIGNED') AS fleet_id, lng, lat,
    CASE status_code WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'PARKED' WHEN 2 THEN 'DRIVING'
      WHEN 3 THEN 'CHARGING' WHEN 4 THEN 'IDLE' WHEN 5 THEN 'FAULT'
      ELSE cast(status_code as varchar) END AS status,
    battery_soc, device_timestamp, ingest_timestamp, record_ts + 7 AS processed_timestamp,
    record_ts, "partition", "offset"
  FROM firsts f LEFT JOIN vehicle_fleet v ON f.vin = v.vin
), admins AS (
  SELECT user_id FROM users WHERE role = 'admin'
), wants_fleet AS (
  SELECT * FROM fleet_grants WHERE user_id NOT IN (SELECT user_id FROM admins)
), wants_vin AS (
  SELECT * FROM vehicle_grants WHERE user_id NOT IN (SELECT user_id FROM admins)
), pairs AS (
  SELECT user_id, c.* FROM canonical c JOIN wants_fleet USING (fleet_id)
  UNION
  SELECT user_id, c.* FROM canonical c JOIN wants_vin USING (vin)
  UNION
  SELECT user_id, c.* FROM canonical c CROSS JOIN admins
), pod_pairs AS (
  SELECT DISTINCT pod, p.* EXCLUDE (user_id)
  FROM pairs p JOIN connections USING (user_id) WHERE s_suppkey % 10 <> 0
), unrouted AS (
  SELECT * FROM canonical WHERE event_id NOT IN (SELECT event_id FROM pod_pairs)
), latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY user_id, vin ORDER BY device_timestamp DESC, ingest_timestamp DESC) AS rn
    FROM pairs WHERE device_timestamp >= {NOW - DAY}) WHERE rn = 1
), admin_board AS (
  SELECT * FROM latest WHERE user_id = 'u-0'
), log AS (
  SELECT CASE WHEN raw.vin = 'BADVIN' THEN '' ELSE concat(raw.vin, '-', device_timestamp) END
      AS event_id, raw.vin, coalesce(v.fleet_id, 'UNASSIGNED') AS fleet_id, lng, lat,
    CASE status_code WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'PARKED' WHEN 2 THEN 'DRIVING'
      WHEN 3 THEN 'CHARGING' WHEN 4 THEN 'IDLE' WHEN 5 THEN 'FAULT'
      ELSE cast(status_code as varchar) END AS status,
    battery_soc, device_timestamp, ingest_timestamp, record_ts + 7 AS processed_timestamp,
    "partition", "offset", device_timestamp = 0 AS cut_off
  FROM raw LEFT JOIN vehicle_fleet v ON raw.vin = v.vin
), published AS (
  SELECT vin, coalesce(fleet_id, 'fleet-old') AS fleet_id FROM cust WHERE c_custkey % 7 <> 0
  UNION ALL
  SELECT {lost_vin('i')}, 'fleet-old' FROM range(5) r(i)
), vehicle_changes AS (
  SELECT CASE WHEN o_orderkey % 100 = 4 THEN 'BADVIN'
      WHEN o_orderkey % 10 = 3 THEN {lost_vin('o_custkey')} ELSE {vin('o_custkey')} END AS vin,
    CASE WHEN o_orderkey % 100 = 8 THEN '' WHEN o_orderkey % 100 = 12 THEN 'fleet-unknown'
      ELSE fleet_id END AS fleet_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN '' ELSE o_orderpriority END AS model, o_orderkey AS seq
  FROM orders JOIN nation_fleet ON o_orderkey % 25 = n_nationkey
), checked_changes AS (
  SELECT *, CASE WHEN octet_length(encode(vin)) <> 17 OR fleet_id = ''
      THEN 'bad_request'
    WHEN length(vin) <> 17 THEN 'bad_vin'
    WHEN fleet_id NOT IN (SELECT fleet_id FROM fleets) THEN 'unknown_fleet'
    ELSE 'ok' END AS result
  FROM vehicle_changes
), grant_requests AS (
  SELECT o_orderkey AS seq, concat('u-', o_custkey % 120) AS user_id,
    CASE WHEN o_orderkey % 5 < 2 THEN fleet_id WHEN o_orderkey % 50 = 7 THEN 'fleet-unknown'
      ELSE '' END AS fleet_id,
    CASE WHEN o_orderkey % 5 > 2 THEN {vin('o_custkey')}
      WHEN o_orderkey % 50 = 1 THEN {lost_vin('o_orderkey')}
      WHEN o_orderkey % 50 = 12 THEN {lost_vin('7')} ELSE '' END AS vin
  FROM orders JOIN nation_fleet ON o_orderkey % 25 = n_nationkey
), checked_grants AS (
  SELECT *, CASE WHEN user_id = '' OR (fleet_id = '') = (vin = '')
      THEN 'bad_request'
    WHEN user_id NOT IN (SELECT user_id FROM users) THEN 'unknown_user'
    WHEN fleet_id <> '' AND fleet_id NOT IN (SELECT fleet_id FROM fleets) THEN 'unknown_fleet'
    WHEN vin <> '' AND vin NOT IN (SELECT vin FROM vehicles) THEN 'unknown_vehicle'
    ELSE 'ok' END AS result
  FROM grant_requests
)
"""

EVENT = """event_id, schema_version, vin, fleet_id, lng, lat, status, battery_soc,
  device_timestamp, ingest_timestamp, processed_timestamp"""
REPORT = """"partition", "offset", vin, lng, lat, status_code, battery_soc, device_timestamp"""
DATE = f"cast(date '1970-01-01' + cast(device_timestamp // {DAY} as integer) as varchar)"
STALE = f"{NOW} - device_timestamp > 60000"


def nearest(x: str) -> str:
    return f"cast(floor({x} + 0.5) as bigint)"


SECONDS = f"greatest(0, {nearest(f'({NOW} - device_timestamp) / 1000.0::double')})"
MINUTES = nearest(f"({SECONDS}) / 60.0::double")
HOURS = nearest(f"({MINUTES}) / 60.0::double")
AGO = f"""CASE WHEN {SECONDS} < 5 THEN 'just now'
  WHEN {SECONDS} < 60 THEN concat({SECONDS}, 's ago')
  WHEN {MINUTES} < 60 THEN concat({MINUTES}, ' min ago')
  ELSE concat({HOURS}, ' h ago') END"""
LABEL = """CASE status WHEN 'DRIVING' THEN 'Driving' WHEN 'CHARGING' THEN 'Charging'
  WHEN 'PARKED' THEN 'Parked' WHEN 'IDLE' THEN 'Idle' WHEN 'FAULT' THEN 'Fault'
  WHEN 'UNSPECIFIED' THEN 'Unknown' END"""
COLOR = f"""CASE WHEN {STALE} THEN '#8d99a3' WHEN status = 'DRIVING' THEN '#1f5fd1'
  WHEN status = 'CHARGING' THEN '#0a8a62' WHEN status = 'PARKED' THEN '#5c6975'
  WHEN status = 'IDLE' THEN '#b7791f' WHEN status = 'FAULT' THEN '#c62f3b' ELSE '#8d99a3' END"""
RANK = """cast(coalesce(list_position(['FAULT', 'DRIVING', 'CHARGING', 'IDLE', 'PARKED'], status), 0)
  as bigint)"""
BAND = "CASE WHEN battery_soc < 15 THEN 'low' WHEN battery_soc < 35 THEN 'mid' ELSE 'ok' END"
CELLS = nearest("battery_soc / 10")
PERCENT = f"concat({nearest('battery_soc')}, '%')"
POSITION = "printf('%.5f, %.5f', lat, lng)"
DELAY = """CASE WHEN processed_timestamp <> 0 AND device_timestamp <> 0
  THEN processed_timestamp - device_timestamp END"""


def fleet_name(column: str) -> str:
    bare = f"regexp_replace({column}, '^fleet-', '')"
    return f"""CASE WHEN {column} = 'UNASSIGNED' THEN 'Unassigned'
      WHEN regexp_matches({bare}, '^[A-Za-z0-9_]')
      THEN concat(upper(substr({bare}, 1, 1)), substr({bare}, 2)) ELSE {bare} END"""


def scope_of(outer: str) -> str:
    return f"""SELECT user_id, role = 'admin' AS all_fleets,
      coalesce((SELECT string_agg(fleet_id, ',' ORDER BY fleet_id) FROM wants_fleet w
                WHERE w.user_id = u.user_id), '') AS fleet_ids,
      coalesce((SELECT string_agg(vin, ',' ORDER BY vin) FROM wants_vin w
                WHERE w.user_id = u.user_id), '') AS vins
    FROM {outer} u"""


def pod_interest(admins: bool) -> str:
    keep = "true" if admins else "s_suppkey % 10 <> 0"
    return f"""
    , held AS (SELECT pod, user_id FROM connections WHERE {keep}),
    everything AS (SELECT DISTINCT pod FROM held JOIN admins USING (user_id)),
    f AS (SELECT pod, string_agg(DISTINCT fleet_id, ',' ORDER BY fleet_id) AS fleet_ids
          FROM held JOIN wants_fleet USING (user_id) GROUP BY pod),
    v AS (SELECT pod, string_agg(DISTINCT vin, ',' ORDER BY vin) AS vins
          FROM held JOIN wants_vin USING (user_id) GROUP BY pod)
    SELECT p.pod, p.pod IN (SELECT pod FROM everything) AS all_fleets,
      CASE WHEN p.pod IN (SELECT pod FROM everything) THEN '' ELSE coalesce(fleet_ids, '') END
        AS fleet_ids,
      CASE WHEN p.pod IN (SELECT pod FROM everything) THEN '' ELSE coalesce(vins, '') END AS vins
    FROM (SELECT DISTINCT pod FROM held) p LEFT JOIN f USING (pod) LEFT JOIN v USING (pod)"""


INTEREST_VERSIONS = """
, held AS (
  SELECT DISTINCT concat('pod-', user_id % 4) AS pod, ms // 3600000 * 3600000 AS as_of,
    concat('u-', user_id) AS user_id FROM ev
), base AS (SELECT DISTINCT pod, as_of FROM held),
everything AS (SELECT DISTINCT pod, as_of, true AS yes FROM held JOIN admins USING (user_id)),
f AS (SELECT pod, as_of, string_agg(DISTINCT fleet_id, ',' ORDER BY fleet_id) AS l
      FROM held JOIN wants_fleet USING (user_id) GROUP BY ALL),
v AS (SELECT pod, as_of, string_agg(DISTINCT vin, ',' ORDER BY vin) AS l
      FROM held JOIN wants_vin USING (user_id) GROUP BY ALL),
snap AS (
  SELECT pod, as_of, coalesce(yes, false) AS all_fleets,
    CASE WHEN yes THEN '' ELSE coalesce(f.l, '') END AS fleet_ids,
    CASE WHEN yes THEN '' ELSE coalesce(v.l, '') END AS vins
  FROM base LEFT JOIN everything USING (pod, as_of) LEFT JOIN f USING (pod, as_of)
    LEFT JOIN v USING (pod, as_of)
), steps AS (
  SELECT *, concat(all_fleets, '|', fleet_ids, '|', vins) <> coalesce(lag(
    concat(all_fleets, '|', fleet_ids, '|', vins)) OVER (PARTITION BY pod ORDER BY as_of),
    'false||') AS changed FROM snap
)
SELECT pod, as_of, row_number() OVER (PARTITION BY pod ORDER BY as_of) AS version, all_fleets,
  fleet_ids, vins FROM steps WHERE changed"""

CONFLATED = """SELECT pod, vin, record_ts // 21600000 * 21600000 AS trigger_ms,
  arg_max(event_id, device_timestamp) AS event_id, count(*) - 1 AS dropped
  FROM pod_pairs GROUP BY ALL"""


def violations() -> str:
    def q(name, body):
        return f"SELECT '{name}' AS \"constraint\", row_key FROM ({body})"

    parts = [
        q("fleets_pkey", "SELECT fleet_id AS row_key FROM bf GROUP BY 1 HAVING count(*) > 1"),
        q("vehicles_pkey", "SELECT vin AS row_key FROM bv WHERE vin IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
        q("users_pkey", "SELECT user_id AS row_key FROM bu GROUP BY 1 HAVING count(*) > 1"),
        q("users_username_key", "SELECT username AS row_key FROM bu WHERE username IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
        q("vehicles_vin_not_null", "SELECT '' AS row_key FROM bv WHERE vin IS NULL"),
        q("users_username_not_null", "SELECT user_id AS row_key FROM bu WHERE username IS NULL"),
        q("users_display_name_not_null", "SELECT user_id AS row_key FROM bu WHERE display_name IS NULL"),
        q(
            "user_fleet_grants_pkey",
            "SELECT concat(user_id, '/', fleet_id) AS row_key FROM bfg GROUP BY 1 HAVING count(*) > 1",
        ),
        q(
            "user_vehicle_grants_pkey",
            "SELECT concat(user_id, '/', vin) AS row_key FROM bvg GROUP BY 1 HAVING count(*) > 1",
        ),
        q("vehicles_vin_check", "SELECT vin AS row_key FROM bv WHERE length(vin) <> 17"),
        q(
            "users_role_check",
            "SELECT user_id AS row_key FROM bu WHERE role NOT IN ('admin','fleet_manager','viewer')",
        ),
        q(
            "vehicles_fleet_id_fkey",
            "SELECT vin AS row_key FROM bv WHERE fleet_id IS NOT NULL AND fleet_id NOT IN (SELECT fleet_id FROM bf)",
        ),
        q(
            "user_fleet_grants_user_id_fkey",
            "SELECT concat(user_id, '/', fleet_id) AS row_key FROM bfg WHERE user_id NOT IN (SELECT user_id FROM bu)",
        ),
        q(
            "user_fleet_grants_fleet_id_fkey",
            "SELECT concat(user_id, '/', fleet_id) AS row_key FROM bfg WHERE fleet_id NOT IN (SELECT fleet_id FROM bf)",
        ),
        q(
            "user_vehicle_grants_user_id_fkey",
            "SELECT concat(user_id, '/', vin) AS row_key FROM bvg WHERE user_id NOT IN (SELECT user_id FROM bu)",
        ),
        q(
            "user_vehicle_grants_vin_fkey",
            "SELECT concat(user_id, '/', vin) AS row_key FROM bvg WHERE vin NOT IN (SELECT vin FROM bv WHERE vin IS NOT NULL)",
        ),
    ]
    tables = f"""
    , bf AS (SELECT * FROM fleets UNION ALL SELECT * FROM fleets WHERE name = 'NATION_3'),
    bv AS (SELECT vin, fleet_id FROM vehicles UNION ALL
      SELECT CASE WHEN c_custkey % 100 = 1 THEN 'SHORT' ELSE {lost_vin('c_custkey')} END,
        'fleet-unknown' FROM customer WHERE c_custkey % 50 = 1 UNION ALL
      SELECT NULL, fleet_id FROM vehicles WHERE model = 'BUILDING'),
    bu AS (SELECT user_id, username, display_name, role FROM users UNION ALL
      SELECT concat('n-', user_id), NULL, NULL, role FROM users WHERE role = 'admin' UNION ALL
      SELECT concat('x-', s_suppkey), concat('u-', s_suppkey), s_name,
        CASE WHEN s_suppkey % 10 = 1 THEN 'owner' ELSE 'viewer' END
      FROM supplier WHERE s_suppkey % 5 = 1),
    bfg AS (SELECT user_id, fleet_id FROM fleet_grants UNION ALL
      SELECT CASE WHEN s_suppkey % 10 = 2 THEN concat('y-', s_suppkey)
          ELSE concat('u-', s_suppkey) END,
        CASE WHEN s_suppkey % 10 = 2 THEN 'fleet-nation_1' ELSE 'fleet-unknown' END
      FROM supplier WHERE s_suppkey % 5 = 2),
    bvg AS (SELECT user_id, vin FROM vehicle_grants UNION ALL
      SELECT concat('u-', s_suppkey), {vin('s_suppkey')} FROM supplier WHERE s_suppkey % 10 = 6
      UNION ALL
      SELECT concat('z-', s_suppkey), {lost_vin('s_suppkey')}
      FROM supplier WHERE s_suppkey % 10 = 7)
    """
    return tables + " UNION ALL ".join(parts)


# True for a payload that is a damaged envelope: sent as JSON, and its text spoilt.
DAMAGED = "(e % 3 = 0 AND e % 11 = 0 AND e % 2 = 0)"
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
DELAY_S = "(processed_timestamp - device_timestamp) / 1000.0::double"

PLAIN = {
    "validate": """SELECT "partition", "offset", coalesce(error, 'ok') AS result FROM checked""",
    "dedup_in_batch": f"SELECT {REPORT}, ingest_timestamp FROM firsts",
    "drop_seen": """SELECT "partition", "offset", vin, device_timestamp
      FROM firsts ANTI JOIN seen USING (vin, device_timestamp)""",
    "enrich_fleet": """SELECT "partition", "offset", vin, fleet_id FROM canonical""",
    "canonicalize": f"SELECT {EVENT} FROM canonical",
    "status_name": "SELECT status, count(*) AS n FROM log GROUP BY status",
    "event_id": """SELECT "partition", "offset", concat(vin, '-', device_timestamp) AS event_id
      FROM raw""",
    "ingest_timestamp": """SELECT "partition", "offset", ingest_timestamp FROM raw""",
    "dead_letter": """SELECT "partition", "offset", error AS reason FROM checked
      WHERE error IS NOT NULL""",
    "processing_outcomes": """
      , good AS (SELECT count(*) AS n FROM checked WHERE error IS NULL),
      fresh AS (SELECT * FROM canonical ANTI JOIN seen USING (vin, device_timestamp))
      SELECT 'invalid' AS outcome, (SELECT count(*) FROM checked WHERE error IS NOT NULL) AS n
      UNION ALL SELECT 'duplicate', (SELECT n FROM good) - (SELECT count(*) FROM fresh)
      UNION ALL SELECT 'unassigned_vin', (SELECT count(*) FROM fresh WHERE fleet_id = 'UNASSIGNED')
      UNION ALL SELECT 'published', (SELECT count(*) FROM fresh)""",
    "fresh_only": f"""SELECT "partition", "offset", record_ts FROM raw
      WHERE record_ts >= {NOW - DAY}""",
    "parse_canonical": f"""SELECT event_id, cast(1 as integer) AS schema_version, vin, fleet_id, lng,
      lat, status, battery_soc, device_timestamp, ingest_timestamp, processed_timestamp
      FROM log WHERE NOT cut_off AND event_id <> ''""",
    "routing_keys": """SELECT "partition", "offset", vin, fleet_id FROM log WHERE NOT cut_off""",
    "geo_point": "SELECT event_id, lat, lng AS lon FROM canonical",
    "event_date": f"""SELECT event_id, {DATE} AS event_date,
      concat('telemetry-', replace({DATE}, '-', '.')) AS index_name FROM canonical""",
    "without_location": f"SELECT {EVENT} FROM canonical",
    "last_24h": f"SELECT {EVENT} FROM canonical WHERE device_timestamp >= {NOW - DAY}",
    "user_scopes": scope_of("users"),
    "check_access": f"""
      , req AS (SELECT event_id AS request_id, concat('u-', user_id) AS user_id,
          CASE WHEN event_id % 4 = 0 THEN '' ELSE fleet_id END AS fleet_id,
          CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN {vin('user_id')}
            ELSE {vin('user_id + 1')} END AS vin
        FROM events JOIN nation_fleet ON event_id % 25 = n_nationkey)
      SELECT req.*, user_id IN (SELECT user_id FROM admins)
        OR (user_id, fleet_id) IN (SELECT (user_id, fleet_id) FROM wants_fleet)
        OR (user_id, vin) IN (SELECT (user_id, vin) FROM wants_vin) AS allowed FROM req""",
    "pod_interest": pod_interest(False),
    "pod_interest_all": pod_interest(True),
    "connected_users": "SELECT DISTINCT pod, user_id FROM connections",
    "route_events": "SELECT pod, event_id FROM pod_pairs",
    "unrouted_events": f"SELECT {EVENT} FROM unrouted",
    "route_events_all": """SELECT DISTINCT pod, event_id FROM pairs JOIN connections USING (user_id)""",
    "unrouted_events_all": f"""SELECT {EVENT} FROM canonical WHERE event_id NOT IN (
      SELECT event_id FROM pairs JOIN connections USING (user_id))""",
    "authorize_events": "SELECT user_id, event_id FROM pairs",
    "two_stage_feed": "SELECT pod, user_id, event_id FROM pairs JOIN connections USING (user_id)",
    "routing_outcomes": f"""
      , c AS ({CONFLATED}), d AS (SELECT cast(sum(dropped) as bigint) AS n FROM c)
      SELECT 'delivered' AS outcome, (SELECT count(*) FROM pod_pairs) - (SELECT n FROM d) AS n
      UNION ALL SELECT 'dropped', (SELECT n FROM d)
      UNION ALL SELECT 'unrouted', (SELECT count(*) FROM unrouted)""",
    "routing_outcomes_all": f"""
      , pp AS (SELECT DISTINCT pod, p.* EXCLUDE (user_id) FROM pairs p JOIN connections USING (user_id)),
      c AS ({CONFLATED.replace("pod_pairs", "pp")}), d AS (SELECT cast(sum(dropped) as bigint) AS n FROM c)
      SELECT 'delivered' AS outcome, (SELECT count(*) FROM pp) - (SELECT n FROM d) AS n
      UNION ALL SELECT 'dropped', (SELECT n FROM d)
      UNION ALL SELECT 'unrouted', (SELECT count(*) FROM canonical WHERE event_id NOT IN (SELECT event_id FROM pp))""",
    "conflate": CONFLATED,
    "conflate_all": CONFLATED.replace(
        "pod_pairs", "(SELECT DISTINCT pod, p.* EXCLUDE (user_id) FROM pairs p JOIN connections USING (user_id))"
    ),
    "interest_versions": INTEREST_VERSIONS,
    "write_history": f"SELECT {DATE} AS event_date, count(*) AS n FROM canonical GROUP BY 1",
    "read_history": f"SELECT {EVENT}, {DATE} AS event_date FROM canonical",
    "upsert_history": f"""SELECT {EVENT.replace('fleet_id', "CASE WHEN \"offset\" % 4 = 0 THEN 'fleet-moved' ELSE fleet_id END AS fleet_id")}
      FROM canonical""",
    "latest_positions": f"""SELECT {EVENT} FROM latest WHERE user_id = 'u-5'""",
    "latest_positions_all": f"SELECT {EVENT} FROM admin_board",
    "merge_newest": f"""SELECT {EVENT}, "offset" + 1 AS arrival_seq FROM (
      SELECT *, row_number() OVER (PARTITION BY vin ORDER BY device_timestamp DESC) AS rn
      FROM canonical) WHERE rn = 1""",
    "history_outcomes": """SELECT CASE WHEN cut_off OR event_id = '' THEN 'skipped'
        WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN 'indexed'
        ELSE 'rejected' END AS outcome, count(*) AS n
      FROM log GROUP BY 1""",
    "scope_text": f"""
      , names AS (SELECT user_id, string_agg({fleet_name('fleet_id')}, ', ' ORDER BY fleet_id) AS t
                  FROM wants_fleet GROUP BY user_id),
      counts AS (SELECT user_id, count(*) AS n FROM wants_vin GROUP BY user_id)
      SELECT user_id, CASE WHEN role = 'admin' THEN 'All fleets'
        WHEN t IS NULL AND n IS NULL THEN 'No vehicles assigned'
        ELSE concat_ws(', ', t, CASE WHEN n > 1 THEN concat(n, ' individual vehicles')
          WHEN n = 1 THEN '1 individual vehicle' END) END AS scope_text
      FROM users LEFT JOIN names USING (user_id) LEFT JOIN counts USING (user_id)""",
    "fleet_name": f"SELECT event_id, {fleet_name('fleet_id')} AS fleet_name FROM canonical",
    "fleet_board": f"""SELECT vin, fleet_id, status, {fleet_name('fleet_id')} AS fleet_name,
      {LABEL} AS status_label, {COLOR} AS status_color, {STALE} AS is_stale, {AGO} AS ago_text,
      {BAND} AS battery_band, {CELLS} AS battery_cells, {PERCENT} AS battery_percent,
      {POSITION} AS position_text, {DELAY} AS pipeline_delay_ms
      FROM admin_board ORDER BY {RANK}, vin""",
    "board_filter": f"""SELECT {EVENT} FROM admin_board
      WHERE contains(vin, 'RA1023')""",
    "board_filter_fleet": f"SELECT {EVENT} FROM admin_board WHERE fleet_id = 'fleet-nation_3'",
    "board_order": f"SELECT vin, {RANK} AS status_rank FROM admin_board ORDER BY 2, 1",
    "vehicle_detail": f"""SELECT {EVENT} FROM canonical WHERE vin = '7H4T9K2L5RA102304'
      ORDER BY device_timestamp DESC LIMIT 1""",
    "status_tally": f"""SELECT status, count(*) AS n, {RANK} > 0 AS shown
      FROM admin_board GROUP BY status""",
    "visible_fleets": "SELECT DISTINCT fleet_id FROM admin_board",
    "map_extent": """SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng,
      max(lng) AS max_lng FROM admin_board""",
    "update_rate": """
      , first_ticks AS (SELECT (record_ts + 899999) // 900000 * 900000 AS t, count(*) AS n
                        FROM canonical GROUP BY 1)
      SELECT t + i * 900000 AS tick_ms, cast(sum(n) as double) / 3600.0::double AS rate
      FROM first_ticks, range(4) r(i) GROUP BY 1""",
    "latency_histogram": " UNION ALL ".join(
        f"SELECT '{b}' AS le, count(*) AS n FROM canonical WHERE {DELAY_S} <= {b}::double"
        for b in BUCKETS
    )
    + " UNION ALL SELECT '+Inf', count(*) FROM canonical",
    "vehicle_fleet_map": "SELECT vin, fleet_id FROM vehicle_fleet",
    "fleet_map_changes": """SELECT vin, fleet_id, 'set' AS op FROM vehicle_fleet UNION ALL
      SELECT vin, NULL, 'delete' FROM published WHERE vin NOT IN (SELECT vin FROM vehicle_fleet)""",
    "apply_fleet_map_changes": "SELECT vin, fleet_id FROM vehicle_fleet",
    "delete_master_data": f"""
      , gf AS (SELECT fleet_id FROM nation_fleet WHERE n_nationkey % 4 = 1),
      gv AS (SELECT {vin('c_custkey')} AS vin FROM customer WHERE c_custkey % 12 = 6),
      gu AS (SELECT concat('u-', s_suppkey) AS user_id FROM supplier WHERE s_suppkey % 9 = 7)
      SELECT 'fleets' AS table_name, fleet_id AS "key", NULL::varchar AS other FROM fleets
        WHERE fleet_id NOT IN (FROM gf)
      UNION ALL SELECT 'vehicles', vin, CASE WHEN fleet_id NOT IN (FROM gf) THEN fleet_id END FROM vehicles
        WHERE vin NOT IN (FROM gv)
      UNION ALL SELECT 'users', user_id, NULL FROM users WHERE user_id NOT IN (FROM gu)
      UNION ALL SELECT 'user_fleet_grants', user_id, fleet_id FROM fleet_grants
        WHERE user_id NOT IN (FROM gu) AND fleet_id NOT IN (FROM gf)
      UNION ALL SELECT 'user_vehicle_grants', user_id, vin FROM vehicle_grants
        WHERE user_id NOT IN (FROM gu) AND vin NOT IN (FROM gv)""",
    "upsert_fleets": f"""SELECT fleet_id, CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, ' depot')
        ELSE n_name END AS name, cast(0 as bigint) AS created_at FROM nation_fleet
      UNION ALL SELECT concat('fleet-', lower(r_name)), r_name, {NOW} FROM region""",
    "upsert_vehicles": f"""
      , good AS (SELECT vin, arg_max(fleet_id, seq) AS new_fleet,
          arg_max(model, seq) FILTER (model <> '') AS new_model
        FROM checked_changes WHERE result = 'ok' GROUP BY vin)
      SELECT vin, coalesce(new_fleet, fleet_id) AS fleet_id, coalesce(new_model, model) AS model,
        CASE WHEN new_fleet IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at
      FROM vehicles FULL JOIN good USING (vin)""",
    "check_vehicle_changes": "SELECT seq, result FROM checked_changes",
    "upsert_users": f"""SELECT coalesce(u.user_id, concat('u-', c_custkey)) AS user_id,
        coalesce(u.username, concat('name-', c_custkey)) AS username,
        coalesce(c_name, display_name) AS display_name,
        CASE WHEN c_custkey IS NULL THEN role WHEN c_custkey % 5 = 0 THEN 'fleet_manager'
          ELSE 'viewer' END AS role, coalesce(created_at, {NOW}) AS created_at
      FROM users u FULL JOIN customer ON u.user_id = concat('u-', c_custkey)""",
    "check_grants": "SELECT seq, result FROM checked_grants",
    "apply_grants": """SELECT user_id, 'fleet' AS kind, fleet_id AS id FROM fleet_grants
      UNION SELECT user_id, 'fleet', fleet_id FROM checked_grants
        WHERE result = 'ok' AND fleet_id <> ''
      UNION SELECT user_id, 'vin', vin FROM vehicle_grants
      UNION SELECT user_id, 'vin', vin FROM checked_grants WHERE result = 'ok' AND vin <> ''""",
    "seed_insert_if_absent": f"""SELECT * FROM vehicles UNION ALL
      SELECT vin, fleet_id, 'Demo EV', {NOW} FROM published
      WHERE vin NOT IN (SELECT vin FROM vehicles)""",
    "master_data_violations": violations(),
    "decode_telemetry": f"SELECT {REPORT} FROM raw",
    "normalize_ingest": f"""
      , sent AS (SELECT *, "offset" // 2 AS e FROM raw)
      SELECT {REPORT}, vin AS "key", record_ts - 5 AS ingest_timestamp
      FROM sent WHERE NOT {DAMAGED}""",
    "normalize_ingest_errors": f"""
      , sent AS (SELECT *, "offset" // 2 AS e FROM raw)
      SELECT "partition", "offset", 'decode base64 payload' AS reason_code FROM sent WHERE {DAMAGED}""",
    "write_canonical": """SELECT vin AS "key", concat('{"eventId":"', event_id,
        '","schemaVersion":1,"vin":"', vin, '","fleetId":"', fleet_id, '","status":"', status,
        '","deviceTimestamp":', device_timestamp, ',"ingestTimestamp":', ingest_timestamp,
        ',"processedTimestamp":', processed_timestamp, '}') AS value_text,
      lng, lat, battery_soc, fleet_id AS fleet_header FROM canonical""",
    "read_raw_stream": f"SELECT {REPORT} FROM raw",
    "dedup_ttl": """SELECT "partition", "offset", vin, device_timestamp, ingest_timestamp
      FROM firsts""",
    "canonical_stream": f"SELECT {EVENT} FROM canonical",
    "dead_letter_stream": """SELECT vin AS "key", error AS reason, "partition", "offset"
      FROM checked WHERE error IS NOT NULL""",
    "processing_outcomes_stream": """
      SELECT 'invalid' AS outcome, (SELECT count(*) FROM checked WHERE error IS NOT NULL) AS n
      UNION ALL SELECT 'duplicate', (SELECT count(*) FROM checked WHERE error IS NULL)
        - (SELECT count(*) FROM canonical)
      UNION ALL SELECT 'unassigned_vin', (SELECT count(*) FROM canonical
        WHERE fleet_id = 'UNASSIGNED')
      UNION ALL SELECT 'published', (SELECT count(*) FROM canonical)""",
    "history_stream": f"SELECT {EVENT}, {DATE} AS event_date FROM canonical",
    "latest_state_stream": f"""SELECT {EVENT} FROM (
      SELECT *, row_number() OVER (PARTITION BY vin ORDER BY device_timestamp DESC) AS rn
      FROM canonical) WHERE rn = 1""",
    "read_live_stream": f"""SELECT "partition", "offset", vin FROM canonical
      WHERE record_ts >= {NOW - DAY}""",
    "live_feed_stream": f"""SELECT user_id, "partition", "offset", vin, fleet_id FROM pairs
      WHERE record_ts >= {NOW - DAY}""",
    "conflated_live_feed": f"""
      SELECT user_id, vin, record_ts // {TRIGGER} * {TRIGGER} AS trigger_ms, last("partition" ORDER BY record_ts, "partition", "offset") AS "partition",
        last("offset" ORDER BY record_ts, "partition", "offset") AS "offset",
        last(fleet_id ORDER BY record_ts, "partition", "offset") AS fleet_id, count(*) - 1 AS dropped
      FROM pairs WHERE record_ts >= {NOW - 30 * DAY} GROUP BY 1, 2, 3""",
    "is_stale": f"SELECT event_id, {STALE} AS is_stale FROM canonical",
    "ago_text": f"SELECT event_id, {AGO} AS ago_text FROM canonical",
    "status_label": f"SELECT event_id, {LABEL} AS status_label FROM canonical",
    "status_color": f"SELECT event_id, {COLOR} AS status_color FROM canonical",
    "battery_band": f"SELECT event_id, {BAND} AS battery_band FROM canonical",
    "battery_cells": f"""SELECT event_id, {CELLS} AS battery_cells, {PERCENT} AS battery_percent
      FROM canonical""",
    "pipeline_delay_ms": f"SELECT event_id, {DELAY} AS pipeline_delay_ms FROM canonical",
    "position_text": f"SELECT event_id, {POSITION} AS position_text FROM canonical",
}


def all_sql() -> dict[str, str]:
    return {name: COMMON + body for name, body in PLAIN.items()}
