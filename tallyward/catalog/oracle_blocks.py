"""Building blocks of the oracle SQL (DuckDB): CTE bodies that restate the operators by hand."""

from __future__ import annotations

from tallyward.catalog.inputs import LANDING_EXPRESSIONS, LAYERS, MORE_LAYERS

LANDING = "SELECT " + ",\n  ".join(f'{e} AS "{c}"' for c, e in LANDING_EXPRESSIONS.items()) + " FROM lineitem"

_REST = ["block", "iucr", "primary_type", "description", "location_description", "arrest", "domestic", "beat", "district",
         "ward", "community_area", "fbi_code", "x_coordinate", "y_coordinate", "year", "latitude", "longitude",
         "location"]
_TIES = ", ".join(f'"{c}" ASC NULLS LAST' for c in _REST)

DEDUPED = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_on DESC NULLS LAST, "date" DESC NULLS LAST,
    case_number DESC NULLS LAST, {_TIES}) AS rn FROM landing) WHERE rn = 1"""

_PT = "upper(trim(coalesce(primary_type, 'Unknown')))"
_DS = "upper(trim(coalesce(description, 'Unknown')))"
_IU = "upper(trim(coalesce(iucr, '0000')))"


def title_case(text: str) -> str:
    return (f"trim(array_to_string(list_transform(string_split(lower(coalesce({text}, 'Unknown')), ' '), "
            f"lambda w: upper(w[1:1]) || w[2:]), ' '))")


def md5_key(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(chr(31), {', '.join(parts)})), 1, 15) AS BIGINT)"


_CATEGORY = """CASE WHEN primary_type IS NULL THEN 'Unknown'
    WHEN pt IN ('HOMICIDE','ROBBERY','BATTERY','ASSAULT','KIDNAPPING','CRIMINAL SEXUAL ASSAULT','HUMAN TRAFFICKING',
      'INTIMIDATION','STALKING') THEN 'Violent'
    WHEN pt IN ('SEX OFFENSE','PROSTITUTION','OFFENSE INVOLVING CHILDREN') THEN 'Sex offense'
    WHEN pt IN ('WEAPONS VIOLATION','CONCEALED CARRY LICENSE VIOLATION') THEN 'Weapons'
    WHEN pt IN ('NARCOTICS','OTHER NARCOTIC VIOLATION','CANNABIS','LIQUOR LAW VIOLATION') THEN 'Drug'
    WHEN pt IN ('THEFT','MOTOR VEHICLE THEFT','BURGLARY','CRIMINAL DAMAGE','CRIMINAL TRESPASS','ARSON',
      'DECEPTIVE PRACTICE','STOLEN PROPERTY','OTHER OFFENSE') THEN 'Property'
    WHEN pt IN ('PUBLIC PEACE VIOLATION','INTERFERENCE WITH PUBLIC OFFICER','OBSCENITY','GAMBLING','RITUALISM',
      'NON-CRIMINAL','NON-CRIMINAL (SUBJECT SPECIFIED)','NON - CRIMINAL') THEN 'Public order'
    ELSE 'Other' END"""
_GROUP = """CASE WHEN pt = 'HOMICIDE' THEN 'Homicide' WHEN pt = 'ROBBERY' THEN 'Robbery'
    WHEN pt = 'BATTERY' AND ds LIKE '%AGGRAVATED%' THEN 'Aggravated battery' WHEN pt = 'BATTERY' THEN 'Battery'
    WHEN pt = 'ASSAULT' AND ds LIKE '%AGGRAVATED%' THEN 'Aggravated assault' WHEN pt = 'ASSAULT' THEN 'Assault'
    WHEN pt = 'CRIMINAL SEXUAL ASSAULT' THEN 'Sexual assault' WHEN pt = 'SEX OFFENSE' THEN 'Sex offense'
    WHEN pt = 'BURGLARY' THEN 'Burglary' WHEN pt = 'THEFT' THEN 'Theft'
    WHEN pt = 'MOTOR VEHICLE THEFT' THEN 'Motor vehicle theft' WHEN pt = 'DECEPTIVE PRACTICE' THEN 'Fraud / deception'
    WHEN pt = 'CRIMINAL DAMAGE' THEN 'Criminal damage' WHEN pt = 'CRIMINAL TRESPASS' THEN 'Criminal trespass'
    WHEN pt = 'ARSON' THEN 'Arson'
    WHEN pt IN ('NARCOTICS','OTHER NARCOTIC VIOLATION','CANNABIS','LIQUOR LAW VIOLATION') THEN 'Drug offense'
    WHEN pt IN ('WEAPONS VIOLATION','CONCEALED CARRY LICENSE VIOLATION') THEN 'Weapons offense'
    WHEN pt = 'OFFENSE INVOLVING CHILDREN' THEN 'Child-related offense'
    WHEN pt = 'PROSTITUTION' THEN 'Commercial sex offense'
    WHEN pt IN ('PUBLIC PEACE VIOLATION','INTERFERENCE WITH PUBLIC OFFICER','OBSCENITY','GAMBLING','RITUALISM',
      'NON-CRIMINAL','NON-CRIMINAL (SUBJECT SPECIFIED)','NON - CRIMINAL') THEN 'Public order offense'
    ELSE clean_type END"""
_SEVERITY = """CASE WHEN pt IN ('HOMICIDE','CRIMINAL SEXUAL ASSAULT','HUMAN TRAFFICKING') THEN 'High'
    WHEN pt IN ('ROBBERY','BATTERY','ASSAULT','KIDNAPPING','WEAPONS VIOLATION','CONCEALED CARRY LICENSE VIOLATION','ARSON')
      THEN 'Medium'
    WHEN pt IN ('THEFT','MOTOR VEHICLE THEFT','BURGLARY','CRIMINAL DAMAGE','CRIMINAL TRESPASS','DECEPTIVE PRACTICE',
      'NARCOTICS','OTHER NARCOTIC VIOLATION','CANNABIS','LIQUOR LAW VIOLATION') THEN 'Low' ELSE 'Variable' END"""
_CLEARANCE = """CASE WHEN pt IN ('HOMICIDE','CRIMINAL SEXUAL ASSAULT') THEN 'High'
    WHEN pt IN ('ROBBERY','BATTERY','ASSAULT','BURGLARY') THEN 'Medium'
    WHEN pt IN ('THEFT','MOTOR VEHICLE THEFT','CRIMINAL DAMAGE','DECEPTIVE PRACTICE') THEN 'Low' ELSE 'Variable' END"""


def classified(source: str) -> str:
    """``source`` plus the fourteen taxonomy columns."""
    return f"""SELECT * EXCLUDE (pt, ds, iu, clean_type, clean_desc),
    {md5_key('iu', 'pt', 'ds')} AS crime_type_key, clean_type AS crime_primary_type_clean,
    clean_desc AS crime_description_clean, iu || ' | ' || pt || ' | ' || ds AS crime_offense_label,
    {_GROUP} AS crime_offense_group, clean_desc AS crime_offense_subtype, {_SEVERITY} AS crime_severity_level,
    CASE crime_category WHEN 'Violent' THEN 'Violent Crime' WHEN 'Property' THEN 'Property Crime'
      WHEN 'Drug' THEN 'Drug Crime' WHEN 'Weapons' THEN 'Weapons Crime' WHEN 'Sex offense' THEN 'Sex Crime'
      WHEN 'Public order' THEN 'Public Order Crime' ELSE 'Other Crime' END AS crime_fbi_classification,
    {_CLEARANCE} AS crime_clearance_bucket,
    CAST(crime_category = 'Violent' AS BIGINT) AS violent_crime_flag,
    CAST(crime_category = 'Property' AS BIGINT) AS property_crime_flag,
    CAST(crime_category = 'Drug' AS BIGINT) AS drug_crime_flag,
    CAST(crime_category = 'Weapons' AS BIGINT) AS weapon_crime_flag
  FROM (SELECT *, {_CATEGORY} AS crime_category FROM (
    SELECT *, {_PT} AS pt, {_DS} AS ds, {_IU} AS iu, {title_case('primary_type')} AS clean_type,
      {title_case('description')} AS clean_desc FROM {source}))"""


def typed(source: str) -> str:
    """Column types of the silver table; unreadable values are null."""
    return f"""SELECT TRY_CAST(id AS BIGINT) AS id, case_number, TRY_CAST("date" AS TIMESTAMP) AS "date", block, iucr,
    primary_type, description, location_description, TRY_CAST(arrest AS BOOLEAN) AS arrest,
    TRY_CAST(domestic AS BOOLEAN) AS domestic, beat, district, ward, community_area, community_area_name,
    district_name, fbi_code, TRY_CAST(x_coordinate AS DOUBLE) AS x_coordinate,
    TRY_CAST(y_coordinate AS DOUBLE) AS y_coordinate, TRY_CAST("year" AS BIGINT) AS "year",
    TRY_CAST(updated_on AS TIMESTAMP) AS updated_on, TRY_CAST(latitude AS DOUBLE) AS latitude,
    TRY_CAST(longitude AS DOUBLE) AS longitude, "location", crime_type_key, crime_primary_type_clean,
    crime_description_clean, crime_offense_label, crime_category, crime_offense_group, crime_offense_subtype,
    crime_severity_level, crime_fbi_classification, crime_clearance_bucket, violent_crime_flag,
    property_crime_flag, drug_crime_flag, weapon_crime_flag,
    CAST(CAST("date" AS DATE) AS TIMESTAMP) AS process_date FROM {source}"""


def layer_ctes(name: str) -> str:
    """poly_<name>(poly_id, poly_name, wkt) and edge_<name>, every edge of every ring."""
    source, _, _, id_expr, label_expr, wkt = (LAYERS | MORE_LAYERS)[name]
    return f"""poly_{name} AS (SELECT {id_expr} AS poly_id, {label_expr} AS poly_name, {wkt} AS wkt FROM {source}),
ring_{name} AS (SELECT poly_id, poly_name,
  list_transform(string_split(unnest(regexp_extract_all(wkt, '\\(([^()]+)\\)', 1)), ', '), lambda p: string_split(p, ' ')) AS pts
  FROM poly_{name}),
edge_{name} AS (SELECT poly_id, poly_name, CAST(pts[i][1] AS DOUBLE) AS x1, CAST(pts[i][2] AS DOUBLE) AS y1,
  CAST(pts[i + 1][1] AS DOUBLE) AS x2, CAST(pts[i + 1][2] AS DOUBLE) AS y2
  FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM ring_{name})),
box_{name} AS (SELECT poly_id, poly_name, min(least(x1, x2)) AS ax, max(greatest(x1, x2)) AS bx, min(least(y1, y2)) AS ay,
  max(greatest(y1, y2)) AS by_ FROM edge_{name} GROUP BY ALL)"""


def hits_cte(name: str, points: str) -> str:
    """hit_<name>(id, poly_id, poly_name): all polygons that hold each point, by crossing count."""
    return f"""hit_{name} AS (SELECT p.id, e.poly_id, e.poly_name FROM {points} p
  JOIN box_{name} b ON p.px BETWEEN b.ax AND b.bx AND p.py BETWEEN b.ay AND b.by_
  JOIN edge_{name} e ON e.poly_id = b.poly_id
  WHERE (e.y1 > p.py) <> (e.y2 > p.py) AND p.px < e.x1 + (e.x2 - e.x1) * (p.py - e.y1) / (e.y2 - e.y1)
  GROUP BY p.id, e.poly_id, e.poly_name HAVING count(*) % 2 = 1),
first_{name} AS (SELECT id, min(poly_id) AS poly_id, arg_min(poly_name, poly_id) AS poly_name FROM hit_{name} GROUP BY id)"""


def _plain_ctes() -> list[str]:
    return [f"landing AS ({LANDING})", f"deduped AS ({DEDUPED})"]


def _silver_ctes(located: bool) -> list[str]:
    parts = _plain_ctes()
    if not located:
        parts.append("geo AS (SELECT *, CAST(NULL AS VARCHAR) AS community_area_name, "
                     "CAST(NULL AS VARCHAR) AS district_name FROM deduped)")
    else:
        parts.append("pts AS (SELECT id, TRY_CAST(longitude AS DOUBLE) AS px, TRY_CAST(latitude AS DOUBLE) AS py "
                     "FROM deduped)")
        for name in LAYERS:
            parts += [layer_ctes(name), hits_cte(name, "pts")]
        parts.append("""geo AS (SELECT d.* EXCLUDE (district, beat, ward, community_area),
  coalesce(nullif(trim(d.district), ''), f1.poly_id) AS district, f1.poly_name AS district_name,
  coalesce(nullif(trim(d.beat), ''), f2.poly_id) AS beat, coalesce(nullif(trim(d.ward), ''), f3.poly_id) AS ward,
  coalesce(nullif(trim(d.community_area), ''), f4.poly_id) AS community_area, f4.poly_name AS community_area_name
  FROM deduped d LEFT JOIN first_districts f1 ON d.id = f1.id LEFT JOIN first_beats f2 ON d.id = f2.id
  LEFT JOIN first_wards f3 ON d.id = f3.id LEFT JOIN first_community_areas f4 ON d.id = f4.id)""")
    parts += [f"classified AS ({classified('geo')})", f"silver AS ({typed('classified')})"]
    return parts


def with_silver(body: str, located: bool = False, extra: list[str] | None = None) -> str:
    """A statement over the CTE ``silver`` (and ``landing``, ``deduped``)."""
    return "WITH " + ",\n".join([*_silver_ctes(located), *(extra or [])]) + "\n" + body


def with_landing(body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([*_plain_ctes(), *(extra or [])]) + "\n" + body


LOCATION_KEY = md5_key("coalesce(beat, '0')", "coalesce(district, '0')", "coalesce(ward, '0')",
                       "coalesce(community_area, '0')", "coalesce(location_description, 'Unknown')",
                       "coalesce(block, 'Unknown')")
DATE_KEY = "CAST(strftime(\"date\", '%Y%m%d') AS INTEGER)"
LAST_DAY = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"
FIRST_DAY = "(SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)"

LOCATION_TYPE = """CASE WHEN regexp_matches(location_description, '(?i)(STREET|SIDEWALK|ALLEY|PARKING)') THEN 'Public/Street'
    WHEN regexp_matches(location_description, '(?i)(RESIDENCE|APARTMENT|HOUSE|HOME)') THEN 'Residential'
    WHEN regexp_matches(location_description, '(?i)(STORE|SHOP|RETAIL|RESTAURANT|BAR)') THEN 'Commercial'
    WHEN regexp_matches(location_description, '(?i)(SCHOOL|COLLEGE|UNIVERSITY)') THEN 'Educational'
    WHEN regexp_matches(location_description, '(?i)(HOSPITAL|MEDICAL)') THEN 'Medical'
    WHEN regexp_matches(location_description, '(?i)(PARK|BEACH|FOREST)') THEN 'Recreation'
    WHEN regexp_matches(location_description, '(?i)(GOVERNMENT|COURT|POLICE)') THEN 'Government'
    WHEN regexp_matches(location_description, '(?i)(CHURCH|TEMPLE|MOSQUE)') THEN 'Religious' ELSE 'Other' END"""
LOCATION_CATEGORY = """CASE location_type WHEN 'Public/Street' THEN 'Public' WHEN 'Residential' THEN 'Private'
    WHEN 'Commercial' THEN 'Semi-Public' WHEN 'Educational' THEN 'Semi-Public' WHEN 'Medical' THEN 'Semi-Public'
    ELSE 'Other' END"""
RISK_LEVEL = """CASE WHEN location_type = 'Public/Street' THEN 'High'
    WHEN location_type IN ('Residential','Educational','Medical','Religious') THEN 'Low' ELSE 'Medium' END"""
TIME_PERIOD = """CASE WHEN {h} BETWEEN 5 AND 11 THEN 'Morning' WHEN {h} BETWEEN 12 AND 17 THEN 'Afternoon'
    WHEN {h} BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Night' END"""
EVENT_KIND = """CASE event_type WHEN 'click' THEN 'THEFT' WHEN 'error' THEN 'BATTERY' WHEN 'purchase' THEN 'NARCOTICS'
    WHEN 'signup' THEN 'WEAPONS VIOLATION' WHEN 'view' THEN 'GAMBLING' END"""
