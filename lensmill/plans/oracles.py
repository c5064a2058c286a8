"""DuckDB SQL for the engine's queries, formulated apart from the Spark code: explicit arithmetic, joins and windows."""

from __future__ import annotations

from lensmill.functions import guidance
from lensmill.plans import fixtures

C = ("tl", "tr", "br", "bl")
NAMED = {"tl": "topleft", "tr": "topright", "br": "bottomright", "bl": "bottomleft"}


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def skew(before: str, at: str, after: str) -> str:
    ax, ay, bx, by = f"({before}_x - {at}_x)", f"({before}_y - {at}_y)", f"({after}_x - {at}_x)", f"({after}_y - {at}_y)"
    n = f"(sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}))"
    return f"CASE WHEN {n} > 0 THEN abs(degrees(acos(greatest(-1.0, least(1.0, ({ax} * {bx} + {ay} * {by}) / {n})))) - 90) ELSE 0 END"


AREA = "abs(" + " + ".join(f"{a}_x * {b}_y - {b}_x * {a}_y" for a, b in zip(C, C[1:] + C[:1], strict=True)) + ") / 2"
XS, YS = ", ".join(f"{c}_x" for c in C), ", ".join(f"{c}_y" for c in C)

GEO = f"""WITH raw AS ({fixtures.FRAMES_SQL}),
ext AS (SELECT *, least({XS}) AS x0, greatest({XS}) AS x1, least({YS}) AS y0, greatest({YS}) AS y1, ({" + ".join(f"{c}_x" for c in C)}) / 4 AS cx, ({" + ".join(f"{c}_y" for c in C)}) / 4 AS cy, {AREA} AS area FROM raw),
geo AS (SELECT * EXCLUDE (document_type), CASE WHEN document_type IN ('PASSPORT', 'VISA', 'ID_CARD', 'DRIVING_LICENCE', 'RESIDENCE_PERMIT') THEN document_type ELSE 'GENERIC' END AS document_type,
  least(1.0::DOUBLE, sqrt(pow(cx - frame_width / 2, 2) + pow(cy - frame_height / 2, 2)) / sqrt(pow(frame_width / 2, 2) + pow(frame_height / 2, 2))) AS off,
  degrees(atan2(tr_y - tl_y, tr_x - tl_x)) AS rot,
  greatest({skew("bl", "tl", "tr")}, {skew("tl", "tr", "br")}, {skew("tr", "br", "bl")}, {skew("br", "bl", "tl")}) AS skew,
  CASE WHEN (x1 - x0) * (y1 - y0) <= 0 THEN 0 ELSE greatest(0, least(1, 1 - greatest(0, least(x1, frame_width) - greatest(x0, 0)) * greatest(0, least(y1, frame_height) - greatest(y0, 0)) / ((x1 - x0) * (y1 - y0)))) END AS outside,
  greatest(0, least(4, area / (frame_width * frame_height))) AS dist
FROM ext)"""

FLAGGED = (
    GEO
    + """,
seen AS (SELECT *, detected AND confidence >= 0.55::DOUBLE AS has FROM geo),
flags AS (SELECT *, has AS has_document, NOT (has AND document_type NOT IN ('GENERIC', 'PASSPORT')) AS is_correct_document_type, NOT has OR off <= 0.18::DOUBLE AS is_centered,
  blur_score >= 60 AS is_sharp, glare_ratio <= 0.08::DOUBLE AS has_no_glare, brightness BETWEEN 60 AND 220 AS has_good_brightness, motion_score <= 0.04::DOUBLE AS is_still,
  NOT has OR dist BETWEEN 0.35::DOUBLE AND 0.92::DOUBLE AS is_correct_size, skew <= 12 AND (NOT has OR abs(rot) <= 8) AS is_correct_perspective, NOT has OR outside <= 0.02::DOUBLE AS is_fully_in_frame FROM seen),
coded AS (SELECT *, """
    + " AND ".join(guidance.FLAGS)
    + """ AS is_valid,
  CASE WHEN NOT has_document THEN 'NO_DOCUMENT' WHEN NOT is_correct_document_type THEN 'WRONG_DOCUMENT_TYPE' WHEN dist < 0.35::DOUBLE THEN 'MOVE_CLOSER' WHEN dist > 0.92::DOUBLE THEN 'MOVE_FARTHER'
    WHEN NOT is_fully_in_frame THEN 'PARTIALLY_OUT_OF_FRAME' WHEN NOT is_centered THEN 'CENTER_DOCUMENT' WHEN abs(rot) > 8 THEN 'ALIGN_DOCUMENT' WHEN skew > 12 THEN 'TILT_PHONE' WHEN NOT is_still THEN 'HOLD_STILL'
    WHEN NOT is_sharp THEN 'BLURRY' WHEN brightness < 60 THEN 'LOW_LIGHT' WHEN brightness > 220 THEN 'OVEREXPOSED' WHEN NOT has_no_glare THEN 'REDUCE_GLARE' ELSE 'READY' END AS code FROM flags)"""
)


def messages(table: dict[str, str]) -> str:
    return "CASE code " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + " END AS message"


def quad_columns(x: str, y: str) -> str:
    return ", ".join(f"{x.format(c=c)} AS {NAMED[c]}_x, {y.format(c=c)} AS {NAMED[c]}_y" for c in C)


FACES = f"""WITH raw AS ({fixtures.FACE_FRAMES_SQL}),
geo AS (SELECT *, detected AND confidence >= 0.6::DOUBLE AS has_face, box_x + box_w / 2 AS cx, box_y + box_h / 2 AS cy, degrees(atan2(left_y - right_y, abs(left_x - right_x))) AS tilt FROM raw),
seen AS (SELECT *, least(1.0::DOUBLE, sqrt(pow(cx - 360, 2) + pow(cy - 640, 2)) / sqrt(pow(360, 2) + pow(640, 2))) AS off, CASE WHEN has_face THEN box_w * box_h / (frame_width * frame_height) ELSE 0.0::DOUBLE END AS ratio FROM geo),
flags AS (SELECT *, NOT has_face OR off <= 0.3::DOUBLE AS is_centered, NOT has_face OR ratio BETWEEN 0.06::DOUBLE AND 0.65::DOUBLE AS is_correct_size, NOT has_face OR abs(tilt) <= 25 AS is_level,
  blur_score >= 15 AS is_sharp, glare_ratio <= 0.15::DOUBLE AS has_no_glare, brightness BETWEEN 40 AND 240 AS has_good_brightness, motion_score <= 0.08::DOUBLE AS is_still FROM seen),
coded AS (SELECT *, {" AND ".join(guidance.FACE_FLAGS)} AS is_valid, CASE WHEN NOT has_face THEN 'NO_FACE' WHEN ratio < 0.06::DOUBLE THEN 'MOVE_CLOSER' WHEN ratio > 0.65::DOUBLE THEN 'MOVE_FARTHER' WHEN NOT is_centered THEN 'CENTER_FACE'
  WHEN NOT is_level THEN 'LEVEL_HEAD' WHEN NOT is_still THEN 'HOLD_STILL' WHEN NOT is_sharp THEN 'BLURRY' WHEN brightness < 40 THEN 'LOW_LIGHT' WHEN brightness > 240 THEN 'OVEREXPOSED' WHEN NOT has_no_glare THEN 'REDUCE_GLARE' ELSE 'READY' END AS code FROM flags)"""


def unit(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def mid(x: str, lo: str, hi: str) -> str:
    return unit(f"1 - abs({x} - ({lo}::DOUBLE + {hi}::DOUBLE) / 2) / (({hi}::DOUBLE - {lo}::DOUBLE) / 2)")


SCORES = {
    "blur": ("blur_score >= 60", unit("blur_score / 120")),
    "light": ("brightness BETWEEN 60 AND 220", mid("brightness", "60", "220")),
    "glare": ("glare_ratio <= 0.08::DOUBLE", unit("1 - glare_ratio / (0.08::DOUBLE * 4)")),
    "motion": ("motion_score <= 0.04::DOUBLE", unit("1 - motion_score / (0.04::DOUBLE * 4)")),
    "distance": ("dist BETWEEN 0.35::DOUBLE AND 0.92::DOUBLE", mid("dist", "0.35", "0.92")),
    "skew": ("skew <= 12", unit("1 - skew / 24")),
}


def orient(x: str, y: str) -> tuple[str, str]:
    """1000 x 800 buffer, turned and mirrored."""
    tx = f"CASE event_id % 4 WHEN 1 THEN 800 - {y} WHEN 3 THEN {y} WHEN 2 THEN 1000 - {x} ELSE {x} END"
    ty = f"CASE event_id % 4 WHEN 1 THEN {x} WHEN 3 THEN 1000 - {x} WHEN 2 THEN 800 - {y} ELSE {y} END"
    return f"(CASE WHEN event_id % 3 = 0 THEN (CASE WHEN event_id % 2 = 1 THEN 800 ELSE 1000 END) - ({tx}) ELSE ({tx}) END)", f"({ty})"


def ordering(points: str, order: str) -> str:
    """CTE text: points(event_id, i, x, y) to the four ordered corners, the first on ties."""
    pick = lambda key, way: f"first(struct_pack(x := x, y := y) ORDER BY {key} {way}, i)"
    return f"{order} AS (SELECT event_id, {pick('x + y', 'ASC')} AS tl, {pick('y - x', 'ASC')} AS tr, {pick('x + y', 'DESC')} AS br, {pick('y - x', 'DESC')} AS bl FROM {points} GROUP BY event_id)"


def unpivot(source: str, listed: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT event_id, {i} AS i, {x} AS x, {y} AS y FROM {source}" for i, (x, y) in enumerate(listed))


ORIENTED = [orient(f"{c}_x", f"{c}_y") for c in C]
_BOX = [("bx0", "by0"), ("bx1", "by0"), ("bx1", "by1"), ("bx0", "by1")]
ORIENTED_BOX = [orient(x, y) for x, y in _BOX]

ALPHA = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def check(text: str, n: int) -> str:
    return "((" + " + ".join(f"greatest(0, strpos({ALPHA}, substr({text}, {i + 1}, 1)) - 1) * CASE WHEN substr({text}, {i + 1}, 1) = '' THEN 0 ELSE {(7, 3, 1)[i % 3]} END" for i in range(n)) + ") % 10)"


def digits(x: str) -> str:
    return f"translate({x}, 'OQDILTZEASGB', '000111234568')"


def letters(x: str) -> str:
    return f"translate({x}, '012568', 'OIZSGB')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(replace({letters(x)}, '<', ' '), '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"trim(replace(regexp_replace({x}, '<+$', ''), '<', ' '))"


def iso(x: str, birth: bool) -> str:
    century = f"CASE WHEN CAST(substr({x}, 1, 2) AS INT) <= 26 THEN '20' ELSE '19' END" if birth else "'20'"
    part = lambda a: f"TRY_CAST(substr({x}, {a}, 2) AS INT)"
    return f"CASE WHEN regexp_matches({x}, '^[0-9]{{6}}$') AND {part(3)} BETWEEN 1 AND 12 AND {part(5)} BETWEEN 1 AND 31 THEN {century} || substr({x}, 1, 2) || '-' || substr({x}, 3, 2) || '-' || substr({x}, 5, 2) ELSE '' END"


def repaired(raw: str, chk: str, n: int) -> tuple[str, str]:
    """Value and whether it fits."""
    fits, other = f"CAST({check(raw, n)} AS VARCHAR) = {digits(chk)}", f"CAST({check(digits(raw), n)} AS VARCHAR) = {digits(chk)}"
    return f"CASE WHEN {fits} THEN {raw} ELSE {digits(raw)} END", f"({fits} OR {other})"


MRZ_CTES = f"""mrz_text AS ({fixtures.MRZ_SQL}),
mrz_lines AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS i, l FROM (
  SELECT c_custkey, unnest(range(1, 100)[:len(s)]) AS i, translate(regexp_replace(upper(unnest(s)), '\\s+', '', 'g'), '«»{{[(}}])', '<<<<<<<<') AS l FROM (SELECT c_custkey, string_split(text, chr(10)) AS s FROM mrz_text)) WHERE length(l) > 0),
mrz_ahead AS (SELECT *, lead(l, 1) OVER w AS b, lead(l, 2) OVER w AS c FROM mrz_lines WINDOW w AS (PARTITION BY c_custkey ORDER BY i)),
mrz_found AS (SELECT c_custkey, i, 0 AS rank, CASE WHEN substr(l, 1, 1) = 'V' THEN 'MRV_A' ELSE 'TD3' END AS format, rpad(l, 44, '<') AS l1, rpad(b, 44, '<') AS l2, NULL AS l3 FROM mrz_ahead
    WHERE length(l) BETWEEN 40 AND 48 AND length(b) BETWEEN 40 AND 48 AND contains(l, '<<') AND substr(l, 1, 1) IN ('P', 'F', 'R', 'V')
  UNION ALL SELECT c_custkey, i, 1, 'TD1', rpad(l, 30, '<'), rpad(b, 30, '<'), rpad(c, 30, '<') FROM mrz_ahead WHERE length(l) BETWEEN 28 AND 32 AND length(b) BETWEEN 28 AND 32 AND length(c) BETWEEN 28 AND 32 AND substr(l, 1, 1) IN ('I', 'A', 'C')
  UNION ALL SELECT c_custkey, i, 2, 'MRV_B', rpad(l, 36, '<'), rpad(b, 36, '<'), NULL FROM mrz_ahead WHERE length(l) BETWEEN 33 AND 39 AND length(b) BETWEEN 33 AND 39 AND contains(l, '<<') AND substr(l, 1, 1) = 'V'),
mrz_block AS (SELECT t.c_custkey, f.format, f.l1, f.l2, f.l3 FROM mrz_text t LEFT JOIN (SELECT * FROM mrz_found QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank, i) = 1) f USING (c_custkey)),
mrz_cut AS (SELECT *, coalesce(format LIKE 'MRV%', FALSE) AS visa,
  CASE WHEN format = 'TD1' THEN substr(l1, 6, 9) ELSE substr(l2, 1, 9) END AS n_raw, CASE WHEN format = 'TD1' THEN substr(l1, 15, 1) ELSE substr(l2, 10, 1) END AS n_chk,
  CASE WHEN format = 'TD1' THEN substr(l2, 1, 6) ELSE substr(l2, 14, 6) END AS d_raw, CASE WHEN format = 'TD1' THEN substr(l2, 7, 1) ELSE substr(l2, 20, 1) END AS d_chk,
  CASE WHEN format = 'TD1' THEN substr(l2, 9, 6) ELSE substr(l2, 22, 6) END AS e_raw, CASE WHEN format = 'TD1' THEN substr(l2, 15, 1) ELSE substr(l2, 28, 1) END AS e_chk,
  CASE WHEN format = 'TD1' THEN substr(l2, 8, 1) ELSE substr(l2, 21, 1) END AS sex, CASE WHEN format = 'TD1' THEN substr(l2, 16, 3) ELSE substr(l2, 11, 3) END AS nat, CASE WHEN format = 'TD1' THEN l3 ELSE substr(l1, 6) END AS nm FROM mrz_block),
mrz_fit AS (SELECT *, {repaired("n_raw", "n_chk", 9)[0]} AS n_val, {repaired("n_raw", "n_chk", 9)[1]} AS n_ok, {repaired("d_raw", "d_chk", 6)[0]} AS d_val, {repaired("d_raw", "d_chk", 6)[1]} AS d_ok, {repaired("e_raw", "e_chk", 6)[0]} AS e_val, {repaired("e_raw", "e_chk", 6)[1]} AS e_ok FROM mrz_cut),
mrz_named AS (SELECT *, coalesce({strip("n_val")}, '') AS num, coalesce({iso("e_val", False)}, '') AS exp, string_split(nm, '<<') AS np FROM mrz_fit),
mrz_out AS (SELECT c_custkey, CASE WHEN visa THEN 'visa' ELSE 'identity' END AS kind, coalesce(format, '') AS format, CAST(coalesce(CAST(n_ok AS INT) + CAST(d_ok AS INT) + CAST(e_ok AS INT), 0) AS INT) AS valid_checks,
  coalesce({clean("array_to_string(np[2:], ' ')")}, '') AS first_name, coalesce({clean("np[1]")}, '') AS last_name, CASE WHEN visa THEN '' ELSE num END AS document_number,
  coalesce({letters(strip("nat"))}, '') AS nationality, coalesce({iso("d_val", True)}, '') AS date_of_birth, CASE sex WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE '' END AS gender,
  CASE WHEN visa THEN '' ELSE exp END AS expiry_date, coalesce({letters(strip("substr(l1, 3, 3)"))}, '') AS issuing_authority, coalesce(l1 || chr(10) || l2 || coalesce(chr(10) || l3, ''), '') AS mrz_raw,
  CASE WHEN visa THEN num ELSE '' END AS visa_number, CASE WHEN visa THEN exp ELSE '' END AS visa_expiry_date, CASE WHEN visa THEN '' ELSE coalesce(format, '') END AS identity_format FROM mrz_named),
mrz AS (SELECT *, format <> '' AND (document_number || visa_number || expiry_date || visa_expiry_date || first_name || last_name || CASE WHEN kind = 'visa' THEN '' ELSE date_of_birth END) <> '' AS ok FROM mrz_out)"""


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def field(x: str) -> str:
    return squeeze(f"regexp_replace({x}, '^[0-9.)\\s:]+', '')")


def date_ctes(name: str, texts: str, pattern: str) -> str:
    """name_dates(capture_id, d list of sorted ISO dates)."""
    one = f"'(?:^|[^A-Za-z0-9_]){pattern}(?:$|[^A-Za-z0-9_])'"
    return f"""{name}_hits AS (SELECT capture_id, line_idx, regexp_extract(upper(text), {one}, 1) AS dd, regexp_extract(upper(text), {one}, 2) AS mm, regexp_extract(upper(text), {one}, 3) AS yy FROM {texts}),
{name}_dates AS (SELECT capture_id, list(yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') ORDER BY yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0')) AS d FROM {name}_hits
  WHERE dd <> '' AND CAST(mm AS INT) BETWEEN 1 AND 12 AND CAST(dd AS INT) BETWEEN 1 AND 31 GROUP BY capture_id)"""


def _slots(raw: str) -> str:
    figures = lambda c: f"translate({c}, '015862', 'OISBGZ')"
    names = lambda c: f"translate({c}, 'OQILZSBG', '00112586')"
    return " || ".join((figures if i in (1, 2, 3, 4, 5, 12, 13, 15, 16) else names)(f"substr({raw}, {i}, 1)") for i in range(1, 17))


LIC_CTES = f"""lic_lines AS ({fixtures.LICENCE_LINES_SQL}),
lic_text AS (SELECT capture_id, string_agg(text, chr(10) ORDER BY y, x) AS text, avg(confidence) AS confidence FROM lic_lines GROUP BY capture_id),
{date_ctes("lic", "lic_lines", "([0-9]{2})[./-]([0-9]{2})[./-]([0-9]{4})")},
lic_raw AS (SELECT t.capture_id, t.text, t.confidence, coalesce(d, []::VARCHAR[]) AS d, regexp_extract(regexp_replace(upper(t.text), '\\s+', ' ', 'g'), '\\b([A-Z0-9]{{13}}[0-9][A-Z0-9]{{2}})(?: ?[0-9]{{0,2}})?\\b', 1) AS raw FROM lic_text t LEFT JOIN lic_dates USING (capture_id)),
lic_num AS (SELECT *, {_slots("raw")} AS num FROM lic_raw),
lic_birth AS (SELECT *, coalesce(d[1], '') AS born, substr(num, 6, 2) AS yy, substr(num, 8, 2) AS mm, substr(num, 10, 2) AS dd FROM lic_num),
lic_months AS (SELECT *, CASE WHEN TRY_CAST(mm AS INT) > 50 THEN lpad(CAST(CAST(mm AS INT) - 50 AS VARCHAR), 2, '0') ELSE mm END AS cm FROM lic_birth),
lic_dob AS (SELECT *, CASE WHEN num <> '' AND born <> '' AND yy <> substr(born, 3, 2) AND coalesce(TRY_CAST(cm AS INT) BETWEEN 1 AND 12, FALSE)
  THEN CAST(CASE WHEN CAST(yy AS INT) > 26 THEN 1900 ELSE 2000 END + CAST(yy AS INT) AS VARCHAR) || '-' || cm || '-' || dd ELSE born END AS dob FROM lic_months),
lic_label AS (SELECT capture_id, max(CASE WHEN before = '1.' THEN text END) AS s1 FROM (SELECT *, lag(text) OVER (PARTITION BY capture_id ORDER BY line_idx) AS before FROM lic_lines) GROUP BY capture_id),
lic_who AS (SELECT l.*, coalesce(s1, nullif(regexp_extract(upper(l.text), '(?:^|\\n)\\s*1[\\s.)\\-:]*([A-Z][A-Z\\s''-]{{1,40}})', 1), ''), CASE WHEN length(regexp_replace(substr(num, 1, 5), '9+$', '')) >= 3 THEN regexp_replace(substr(num, 1, 5), '9+$', '') END, '') AS s,
  regexp_extract(upper(l.text), '(?:^|\\n)\\s*2[\\s.)\\-:]*([A-Z][A-Z\\s''-]{{1,40}})', 1) AS g FROM lic_dob l JOIN lic_label USING (capture_id)),
lic_cand AS (SELECT capture_id, list(text ORDER BY y, line_idx) AS c FROM lic_lines WHERE y < 0.55::DOUBLE AND regexp_matches(trim(text), '^[A-Z][A-Z\\s''-]+$') AND NOT regexp_matches(text, 'DRIVING|LICEN[CS]E|UNITED|KINGDOM') GROUP BY capture_id),
lic_addr AS (SELECT capture_id, string_agg({field("text")}, ', ' ORDER BY line_idx) AS address FROM lic_lines WHERE line_idx BETWEEN 7 AND 10 AND {field("text")} <> '' GROUP BY capture_id),
lic AS (SELECT w.capture_id, w.text, w.confidence, num AS licence_number, CASE WHEN len(d) = 0 THEN '' ELSE dob END AS date_of_birth, CASE WHEN len(d) >= 3 THEN d[2] ELSE '' END AS issue_date, CASE WHEN len(d) >= 2 THEN d[-1] ELSE '' END AS expiry_date,
  trim({field("CASE WHEN g = '' THEN coalesce(c[2], '') ELSE g END")} || ' ' || {field("CASE WHEN s = '' THEN coalesce(c[1], '') ELSE s END")}) AS full_name, coalesce(a.address, '') AS address FROM lic_who w LEFT JOIN lic_cand USING (capture_id) LEFT JOIN lic_addr a USING (capture_id))"""

ID_CTES = f"""id_lines AS ({fixtures.CARD_LINES_SQL}),
id_text AS (SELECT capture_id, string_agg(text, chr(10) ORDER BY y, x) AS text, avg(confidence) AS confidence, count(*) AS n FROM id_lines GROUP BY capture_id),
{date_ctes("id", "id_lines", "([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})")},
id_line AS (SELECT capture_id, arg_min(text, line_idx) AS told FROM id_lines WHERE regexp_matches(upper(text), 'ID|NUMBER|NO[.:]') GROUP BY capture_id),
id_cand AS (SELECT capture_id, first(trim(text) ORDER BY length(text) DESC, line_idx) AS name FROM id_lines WHERE y < 0.55::DOUBLE AND regexp_matches(trim(text), '^[A-Z][A-Z\\s''-]{{2,40}}$') AND NOT regexp_matches(upper(text), 'IDENTITY|CARD|NATIONAL|REPUBLIC|GOVERNMENT') GROUP BY capture_id),
id_from AS (SELECT capture_id, min(line_idx) AS a FROM id_lines WHERE contains(upper(text), 'ADDRESS') GROUP BY capture_id),
id_addr AS (SELECT l.capture_id, string_agg(trim(l.text), ', ' ORDER BY line_idx) AS address FROM id_lines l JOIN id_from f ON l.capture_id = f.capture_id AND line_idx BETWEEN a AND a + 2 WHERE trim(l.text) <> '' GROUP BY l.capture_id),
idc AS (SELECT t.capture_id, t.text, t.confidence, t.n, coalesce(c.name, '') AS full_name, regexp_extract(upper(coalesce(told, t.text)), '\\b[A-Z0-9]{{6,15}}\\b') AS id_number, coalesce(d[1], '') AS date_of_birth, CASE WHEN len(d) > 1 THEN d[-1] ELSE '' END AS expiry_date, coalesce(address, '') AS address
  FROM id_text t LEFT JOIN id_dates USING (capture_id) LEFT JOIN id_line USING (capture_id) LEFT JOIN id_cand c USING (capture_id) LEFT JOIN id_addr USING (capture_id))"""

VEC = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def heat(c: int) -> tuple[str, str, str]:
    part = f"e[{16 * c + 1}:{16 * c + 16}]"
    at, top = f"(list_position({part}, list_max({part})) - 1)", f"list_max({part})"
    return f"(({at} % 4) + 0.5::DOUBLE) * 64", f"(({at} // 4) + 0.5::DOUBLE) * 64", f"CASE WHEN {top} BETWEEN 0 AND 1 THEN {top} ELSE 1 / (1 + exp(-({top}))) END"


FACE_SELECTS = " UNION ALL ".join(
    f"""SELECT vec_id, {i} AS cell, {i % 2} AS c, {i // 2} AS r, least(1.0::DOUBLE, abs(e[{16 * i + 1}]) * 3) AS cl, least(1.0::DOUBLE, abs(e[{16 * i + 2}]) * 3) AS ob, e[{16 * i + 3}] AS bx, e[{16 * i + 4}] AS "by", exp(e[{16 * i + 5}]) * 32 AS w, exp(e[{16 * i + 6}]) * 32 AS h, e[{16 * i + 7}] AS k0, e[{16 * i + 16}] AS k9 FROM v"""
    for i in range(4)
)
BOX_SELECTS = " UNION ALL ".join(
    f"SELECT vec_id, {i} AS cell, e[{8 * i + 1}] * 100 AS x, e[{8 * i + 2}] * 100 AS y, abs(e[{8 * i + 3}]) * 100 + 20 AS w, abs(e[{8 * i + 4}]) * 100 + 20 AS h, abs(e[{8 * i + 5}]) * 2 + 0.5::DOUBLE AS score FROM v" for i in range(8)
)
#: Suppression unrolled over ranks: the kept set is a bit mask.
NMS = (
    VEC
    + f""", boxes AS ({BOX_SELECTS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS n FROM boxes WHERE score >= 0.7::DOUBLE),
pairs AS (SELECT a.vec_id, a.n, b.n AS m FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id AND b.n < a.n
  WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
    / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) >= 0.3::DOUBLE),
masks AS (SELECT r.vec_id, r.n, coalesce(sum(1 << (m - 1)), 0)::BIGINT AS mask FROM ranked r LEFT JOIN pairs p ON r.vec_id = p.vec_id AND r.n = p.n GROUP BY r.vec_id, r.n),
"""
    + "k1 AS (SELECT vec_id, n, 1::BIGINT AS kept FROM masks WHERE n = 1),\n"
    + ",\n".join(f"k{i} AS (SELECT k.vec_id, {i} AS n, CASE WHEN (m.mask & k.kept) = 0 THEN k.kept | (1 << {i - 1}) ELSE k.kept END AS kept FROM k{i - 1} k JOIN masks m ON m.vec_id = k.vec_id AND m.n = {i})" for i in range(2, 9))
    + ",\nkepts AS ("
    + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(1, 9))
    + """)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY n) - 1 AS INT) AS "rank", cell, """
    + r6("score")
    + " AS score FROM kepts JOIN ranked USING (vec_id, n) WHERE (kept >> (n - 1)) & 1 = 1"
)

REG = "WITH reg AS (SELECT 'm' || (p_partkey % 50) AS id, p_name AS label, p_brand AS license, p_partkey AS registered_seq FROM part), latest AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY id ORDER BY registered_seq DESC) = 1), log AS (SELECT o_custkey % 100 AS app_id, o_orderkey AS seq, 'm' || ((o_orderkey * 7) % 60) AS model_id FROM orders)"

SQL = {
    "g_geometry": f"{GEO} SELECT event_id, {r6('sqrt(pow(tl_x - tr_x, 2) + pow(tl_y - tr_y, 2))')} AS top_edge, {r6('cx')} AS center_x, {r6('cy')} AS center_y, {r6('area')} AS area, {r6('off')} AS offset_ratio, {r6('rot')} AS rotation_deg, {r6('skew')} AS skew_deg, {r6('outside')} AS out_ratio, {r6('dist')} AS distance_ratio FROM geo",
    "g_bbox_and_domain": f"{GEO} SELECT event_id, document_type, CASE WHEN detected THEN least(tl_x, bl_x) END AS box_x, CASE WHEN detected THEN least(tl_y, tr_y) END AS box_y, CASE WHEN detected THEN greatest(tr_x, br_x) - least(tl_x, bl_x) END AS box_width, CASE WHEN detected THEN greatest(bl_y, br_y) - least(tl_y, tr_y) END AS box_height, CASE WHEN detected THEN tl_x ELSE -1 END AS tl_x_or_default FROM geo",
    "g_order_points": f"WITH raw AS ({fixtures.FRAMES_SQL}), pts AS ({unpivot('raw', [(f'{c}_x', f'{c}_y') for c in ('br', 'tl', 'bl', 'tr')])}), {ordering('pts', 'o')} SELECT event_id, {quad_columns('{c}.x', '{c}.y')} FROM o",
    "g_orientation": f"WITH raw AS (SELECT *, least(tl_x, bl_x) AS bx0, least(tl_y, tr_y) AS by0, greatest(tr_x, br_x) AS bx1, greatest(bl_y, br_y) AS by1 FROM ({fixtures.FRAMES_SQL})), pts AS ({unpivot('raw', ORIENTED)}), {ordering('pts', 'o')}, box AS (SELECT event_id, least({', '.join(x for x, _ in ORIENTED_BOX)}) AS x0, greatest({', '.join(x for x, _ in ORIENTED_BOX)}) AS x1, least({', '.join(y for _, y in ORIENTED_BOX)}) AS y0, greatest({', '.join(y for _, y in ORIENTED_BOX)}) AS y1 FROM raw) SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 800.0::DOUBLE ELSE 1000 END AS display_width, CASE WHEN event_id % 2 = 1 THEN 1000.0::DOUBLE ELSE 800 END AS display_height, {quad_columns('{c}.x', '{c}.y')}, x0 AS box_x, y0 AS box_y, x1 - x0 AS box_width, y1 - y0 AS box_height FROM o JOIN box USING (event_id)",
    "g_clamp": f"WITH raw AS ({fixtures.FRAMES_SQL}), q AS (SELECT event_id, {', '.join(f'greatest(0.0::DOUBLE, least(999, {c}_x)) AS {c}_x, greatest(0.0::DOUBLE, least(799, {c}_y)) AS {c}_y' for c in C)} FROM raw) SELECT event_id, {quad_columns('{c}_x', '{c}_y')}, greatest({XS}) - least({XS}) AS box_width, greatest({YS}) - least({YS}) AS box_height, {r6(f'least({XS}) / 1000')} AS norm_x, {r6(f'least({YS}) / 800')} AS norm_y FROM q",
    "g_view_scale": f"WITH raw AS ({fixtures.FRAMES_SQL}), g AS (SELECT *, (390.0::DOUBLE + event_id % 5) AS vw, (event_id % 101) / 100.0::DOUBLE AS p, event_id % 1500 AS sz FROM raw) SELECT event_id, {r6('br_x * (390.0::DOUBLE / 1000)')} AS view_x, {r6('CASE WHEN event_id % 17 = 0 THEN 0 ELSE br_y * (844.0::DOUBLE / 800) END')} AS view_y, {r6('(vw - vw * 0.86::DOUBLE) / 2')} AS guide_x, {r6('(844.0::DOUBLE - vw * 0.86::DOUBLE / 1.42::DOUBLE) / 2')} AS guide_y, {r6('vw * 0.86::DOUBLE')} AS guide_width, {r6('vw * 0.86::DOUBLE / 1.42::DOUBLE')} AS guide_height, {r6('CASE WHEN p < 0.12::DOUBLE THEN p / 0.12::DOUBLE WHEN p > 1 - 0.12::DOUBLE THEN (1 - p) / 0.12::DOUBLE ELSE 1 END')} AS fade, 'file:///p/' || event_id AS photo_uri, '/p/' || event_id AS photo_path, CAST(greatest(32, ((least(sz, 960) + 31) // 32) * 32) AS INT) AS side32 FROM g",
    "guidance_flags": f"{FLAGGED} SELECT event_id, {', '.join(guidance.FLAGS)}, is_valid FROM coded",
    "guidance_code": f"{FLAGGED} SELECT session_id, event_id, timestamp_ms, code, {messages(guidance.MESSAGES)}, is_valid, confidence FROM coded",
    "guidance_code_counts": f"{FLAGGED} SELECT code, count(*) AS n, count(*) FILTER (is_valid) AS n_valid FROM coded GROUP BY code",
    "face_geometry": f"{FACES} SELECT event_id, cx AS center_x, cy AS center_y, {r6('off')} AS offset_ratio, {r6('tilt')} AS tilt_deg FROM seen WHERE detected",
    "face_guidance": f"{FACES} SELECT event_id, {', '.join(guidance.FACE_FLAGS)}, code, {messages(guidance.FACE_MESSAGES)}, is_valid, {r6('ratio')} AS size_ratio FROM coded",
    "quality_indicators": f"{GEO} SELECT event_id, {', '.join(f'{p} AS {k}_passed, {r6(s)} AS {k}_score' for k, (p, s) in SCORES.items())} FROM geo",
    "quality_score": f"{GEO} SELECT event_id, CAST(floor(({' + '.join(s for _, s in SCORES.values())}) / 6 * 100 + 0.5::DOUBLE) AS BIGINT) AS quality_score, CAST(floor(confidence * 100 + 0.5::DOUBLE) AS BIGINT) AS percent FROM geo",
    "mrz_fields": f"WITH p AS (SELECT *, 'L' || substr(doc_no, 2, 8) AS number, CAST(c_custkey % 10 AS VARCHAR) AS chk, CASE WHEN c_custkey % 3 = 0 THEN replace(dob, '0', 'O') ELSE dob END AS spoiled FROM ({fixtures._PARTS})), q AS (SELECT *, CAST({check('dob', 6)} AS VARCHAR) AS dchk FROM p), r AS (SELECT *, {repaired('number', 'chk', 9)[0]} AS number_value, {repaired('number', 'chk', 9)[1]} AS number_ok, {repaired('spoiled', 'dchk', 6)[0]} AS dob_value, {repaired('spoiled', 'dchk', 6)[1]} AS dob_ok FROM q) SELECT c_custkey, CAST({check('number', 9)} AS INT) AS number_check, number_value, number_ok, dob_value, dob_ok, {iso('dob_value', True)} AS born, {iso('expiry', False)} AS expires, {clean('names')} AS clean_names, {strip('names')} AS stripped, {letters('doc_no')} AS lettered, CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE '' END AS gender FROM r",
    "mrz_parse": f"WITH {MRZ_CTES} SELECT c_custkey, ok, kind, format, valid_checks, first_name, last_name, document_number, nationality, date_of_birth, gender, expiry_date, issuing_authority, mrz_raw, visa_number, visa_expiry_date, identity_format FROM mrz",
    "ocr_fulltext": f"WITH {ID_CTES} SELECT capture_id, text AS full_text, {r6('confidence')} AS mean_confidence, CAST(n AS INT) AS n_lines FROM idc",
    "licence_parse": f"WITH {LIC_CTES} SELECT capture_id, licence_number <> '' OR full_name <> '' AS ok, full_name, licence_number, date_of_birth, issue_date, expiry_date, address, 'United Kingdom' AS country FROM lic",
    "licence_categories": f"WITH {LIC_CTES} SELECT capture_id, CASE capture_id % 3 WHEN 0 THEN 'AM,A1' WHEN 1 THEN 'B,BE,C1' ELSE '' END AS categories FROM lic",
    "id_parse": f"WITH {ID_CTES} SELECT capture_id, id_number <> '' OR full_name <> '' AS ok, full_name, id_number, date_of_birth, expiry_date, address, '' AS nationality FROM idc",
    "extract_document": f"""WITH {LIC_CTES}, {ID_CTES}, {MRZ_CTES},
z AS (SELECT m.*, CASE WHEN c_custkey % 13 = 0 THEN 'GENERIC' WHEN c_custkey % 2 = 0 THEN 'VISA' ELSE 'PASSPORT' END AS t, c_custkey % 17 = 0 AS blank FROM mrz m)
SELECT 2 * capture_id AS capture_id, licence_number <> '' OR full_name <> '' AS success, 'null' AS mrz_valid, 'DRIVING_LICENCE' AS document_type, full_name AS name, licence_number AS document_number, date_of_birth AS dob, expiry_date AS expiry, 'United Kingdom' AS nationality, address, '' AS mrz, {r6("confidence")} AS confidence FROM lic
UNION ALL SELECT 2 * capture_id + 1, id_number <> '' OR full_name <> '', 'null', 'RESIDENCE_PERMIT', full_name, id_number, date_of_birth, expiry_date, '', address, '', {r6("confidence")} FROM idc
UNION ALL SELECT -c_custkey, CASE WHEN blank OR t = 'GENERIC' THEN FALSE ELSE ok END, CASE WHEN blank OR t = 'GENERIC' OR NOT ok THEN 'null' WHEN valid_checks = 3 THEN 'true' ELSE 'false' END, t,
  CASE WHEN blank OR t = 'GENERIC' THEN '' ELSE trim(first_name || ' ' || last_name) END, CASE WHEN blank OR t = 'GENERIC' THEN '' WHEN kind = 'visa' THEN visa_number ELSE document_number END, CASE WHEN blank OR t = 'GENERIC' THEN '' ELSE date_of_birth END,
  CASE WHEN blank OR t = 'GENERIC' THEN '' WHEN kind = 'visa' THEN visa_expiry_date ELSE expiry_date END, CASE WHEN blank OR t = 'GENERIC' THEN '' ELSE nationality END, '', CASE WHEN blank OR t = 'GENERIC' THEN '' ELSE mrz_raw END, CASE WHEN blank THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END FROM z""",
    "throttle": f"WITH RECURSIVE raw AS (SELECT session_id, event_id, timestamp_ms FROM ({fixtures.FRAMES_SQL})), walk AS (SELECT session_id, min(timestamp_ms) AS t FROM raw WHERE timestamp_ms >= 66 GROUP BY session_id UNION ALL SELECT w.session_id, (SELECT min(r.timestamp_ms) FROM raw r WHERE r.session_id = w.session_id AND r.timestamp_ms >= w.t + 66) AS t FROM walk w WHERE w.t IS NOT NULL) SELECT r.session_id, r.event_id, r.timestamp_ms FROM raw r JOIN walk w ON r.session_id = w.session_id AND r.timestamp_ms = w.t",
    "stability_gate": f"{FLAGGED}, runs AS (SELECT session_id, event_id, timestamp_ms, is_valid, max(CASE WHEN NOT is_valid THEN timestamp_ms ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS broken FROM coded), since AS (SELECT *, min(CASE WHEN is_valid THEN timestamp_ms END) OVER (PARTITION BY session_id, broken) AS s FROM runs), shots AS (SELECT *, min(CASE WHEN is_valid AND timestamp_ms - s >= 1000 THEN timestamp_ms END) OVER (PARTITION BY session_id) AS shot FROM since) SELECT session_id, event_id, CASE WHEN coalesce(timestamp_ms >= shot, FALSE) THEN 'capturing' WHEN is_valid THEN 'stabilizing' ELSE 'idle' END AS stage, {r6('CASE WHEN coalesce(timestamp_ms >= shot, FALSE) THEN 1 WHEN is_valid THEN least(1.0::DOUBLE, (timestamp_ms - s) / 1000.0::DOUBLE) ELSE 0 END')} AS stability_progress, coalesce(shot, -1) AS captured_at FROM shots",
    "latest_state": f"{FLAGGED} SELECT session_id, timestamp_ms, event_id, code, is_valid, frame_width, frame_height, n_frames FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_frames, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms DESC) AS r FROM coded) WHERE r = 1",
    "asof_quad": f"WITH raw AS ({fixtures.FRAMES_SQL}), shots AS (SELECT session_id, event_id AS capture_id, timestamp_ms - event_id % 120 AS timestamp_ms FROM raw), seen AS (SELECT session_id, timestamp_ms AS frame_ms, CASE WHEN detected THEN tl_x END AS q FROM raw) SELECT s.session_id, capture_id, timestamp_ms, coalesce(frame_ms, -1) AS frame_ms, coalesce(q, -1) AS tl_x FROM shots s ASOF LEFT JOIN seen f ON s.session_id = f.session_id AND s.timestamp_ms >= f.frame_ms",
    "heatmap_decode": f"{VEC}, h AS (SELECT vec_id, e, {', '.join(f'{heat(c)[0]} AS x{c}, {heat(c)[1]} AS y{c}, {heat(c)[2]} AS p{c}' for c in range(4))} FROM v) SELECT vec_id, {', '.join(f'x{c}, y{c}' for c in range(4))}, {r6('(p0 + p1 + p2 + p3) / 4')} AS confidence, {', '.join(r6(f'CASE WHEN e[{i + 1}] BETWEEN -0.01::DOUBLE AND 1.01::DOUBLE THEN e[{i + 1}] * 256 ELSE e[{i + 1}] END') + f' AS direct_{i}' for i in range(8))}, {', '.join(r6(f'greatest(0, least(1000, x{c} / 0.256::DOUBLE))') + f' AS frame_x{c}, ' + r6(f'greatest(0, least(800, y{c} / 0.32::DOUBLE))') + f' AS frame_y{c}' for c in range(4))} FROM h",
    "class_softmax": f"{VEC}, l AS (SELECT vec_id, list_transform(e[1:6], lambda x: x * 8) AS a FROM v), s AS (SELECT vec_id, ['PASSPORT', 'DRIVING_LICENCE', 'ID_CARD', 'RESIDENCE_PERMIT', 'VISA', 'GENERIC'][list_position(a, list_max(a))] AS label, 1 / ({' + '.join(f'exp(a[{i}] - list_max(a))' for i in range(1, 7))}) AS p FROM l) SELECT vec_id, label, {r6('p')} AS confidence, CASE WHEN p >= 0.6::DOUBLE THEN label ELSE 'GENERIC' END AS trusted FROM s",
    "ctc_decode": f"{VEC}, steps AS (SELECT vec_id, t, e[t * 8 + 1 : t * 8 + 8] AS a FROM v, range(8) r(t)), best AS (SELECT vec_id, t, list_position(a, list_max(a)) - 1 AS k, 1 / ({' + '.join(f'exp(a[{i}] - list_max(a))' for i in range(1, 9))}) AS p FROM steps), fresh AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM best), kept AS (SELECT * FROM fresh WHERE k <> 0 AND k IS DISTINCT FROM before) SELECT v.vec_id, coalesce(string_agg(['A', 'B', 'C', 'D', 'E', 'F', ' '][k], '' ORDER BY t), '') AS text, {r6('coalesce(avg(p), 0)')} AS confidence FROM v LEFT JOIN kept USING (vec_id) GROUP BY v.vec_id",
    "face_decode": f"{VEC}, f AS ({FACE_SELECTS}) SELECT vec_id, cell, {r6('(c + bx) * 32 - w / 2')} AS x, {r6('(r + ' + chr(34) + 'by' + chr(34) + ') * 32 - h / 2')} AS y, {r6('w')} AS w, {r6('h')} AS h, {r6('sqrt(cl * ob)')} AS score, {r6('(k0 + c) * 32')} AS eye_x, {r6('(k9 + r) * 32')} AS mouth_y FROM f",
    "nms": NMS,
    "registry_latest": f"{REG} SELECT id, label, license, registered_seq FROM latest",
    "registry_active": f"{REG} SELECT app_id, coalesce(max_by(model_id, seq) FILTER (model_id IN (SELECT id FROM latest)), 'default-docaligner-rapidocr-v1') AS active_id FROM log GROUP BY app_id",
    "registry_activations": f"{REG}, k AS (SELECT *, model_id IN (SELECT id FROM latest) AS known FROM log), o AS (SELECT *, last_value(CASE WHEN known THEN model_id END IGNORE NULLS) OVER (PARTITION BY app_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) SELECT app_id, CASE WHEN NOT known THEN 'error' WHEN before = model_id THEN 'noop' ELSE 'loaded' END AS outcome, count(*) AS n FROM o GROUP BY ALL",
}


PIXELS = "WITH px AS (SELECT event_id, user_id AS session_id, x, y, (event_id * 31 + x * 7 + y * 13 + x * y * (event_id % 5)) % 256 AS v FROM events, range(16) a(x), range(12) b(y))"
#: Neighbours with mirrored borders, as self-joins would find them, by windows over rows and columns.
SQL["pix_quality"] = f"""{PIXELS}, n AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER c AS u, lead(v) OVER c AS d FROM px WINDOW r AS (PARTITION BY event_id, y ORDER BY x), c AS (PARTITION BY event_id, x ORDER BY y)),
lap AS (SELECT *, coalesce(l, rt) + coalesce(rt, l) + coalesce(u, d) + coalesce(d, u) - 4 * v AS z FROM n)
SELECT event_id AS image_id, {r6("var_pop(z)")} AS blur_score, {r6("avg(v)")} AS brightness, {r6("count(*) FILTER (v > 250) / count(*)")} AS glare_ratio FROM lap GROUP BY event_id"""
SQL["pix_motion"] = f"""{PIXELS}, b AS (SELECT *, lag(v) OVER (PARTITION BY session_id, x, y ORDER BY event_id) AS w FROM px)
SELECT session_id, event_id, {r6("avg(coalesce(abs(v - w), 0)) / 255")} AS motion_score FROM b GROUP BY session_id, event_id"""
SQL["capture_replay"] = (
    FLAGGED.replace("WITH raw AS", "WITH RECURSIVE raw AS", 1)
    + f""", walk AS (SELECT session_id, min(timestamp_ms) AS t FROM coded WHERE timestamp_ms >= 66 GROUP BY session_id UNION ALL SELECT w.session_id, (SELECT min(r.timestamp_ms) FROM coded r WHERE r.session_id = w.session_id AND r.timestamp_ms >= w.t + 66) AS t FROM walk w WHERE w.t IS NOT NULL),
fwd AS (SELECT c.session_id, c.timestamp_ms, c.is_valid FROM coded c JOIN walk w ON c.session_id = w.session_id AND c.timestamp_ms = w.t),
runs AS (SELECT *, max(CASE WHEN NOT is_valid THEN timestamp_ms ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS broken FROM fwd),
since AS (SELECT *, min(CASE WHEN is_valid THEN timestamp_ms END) OVER (PARTITION BY session_id, broken) AS s FROM runs),
shots AS (SELECT *, min(CASE WHEN is_valid AND timestamp_ms - s >= 1000 THEN timestamp_ms END) OVER (PARTITION BY session_id) AS shot FROM since),
staged AS (SELECT *, CASE WHEN timestamp_ms = shot THEN 'capturing' WHEN is_valid THEN 'stabilizing' ELSE 'idle' END AS stage FROM shots WHERE shot IS NULL OR timestamp_ms <= shot),
changed AS (SELECT *, lag(stage, 1, 'idle') OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS before FROM staged)
SELECT session_id, timestamp_ms, stage, {r6("CASE WHEN is_valid THEN least(1.0::DOUBLE, (timestamp_ms - s) / 1000.0::DOUBLE) ELSE 0 END")} AS stability_progress FROM changed WHERE stage <> before"""
)
SQL["ctc_decode_ios"] = SQL["ctc_decode"].replace("AND k IS DISTINCT FROM before)", "AND k IS DISTINCT FROM before AND k < 7)")
SQL["stream_throttle_gate"] = SQL["sql_capture_replay"] = SQL["capture_replay"]
SQL["sql_throttle"], SQL["sql_stability_gate"] = SQL["throttle"], SQL["stability_gate"]
SQL["sql_extract_document"], SQL["sql_id_parse"] = SQL["extract_document"], SQL["id_parse"]
_AREA = "abs((tl_x * tr_y - tr_x * tl_y) + (tr_x * br_y - br_x * tr_y) + (br_x * bl_y - bl_x * br_y) + (bl_x * tl_y - tl_x * bl_y)) / 2"
_SIZE = "CASE event_id % 3 WHEN 0 THEN 800000.0::DOUBLE WHEN 1 THEN 8000.0::DOUBLE ELSE 0.25::DOUBLE END"
SQL["g_ios"] = f"""SELECT event_id, detected AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS found, detected AS found_android, {r6(f'{_AREA} / greatest(1.0::DOUBLE, {_SIZE})')} AS distance_ratio,
  {r6(f'greatest(0.0::DOUBLE, least(4.0::DOUBLE, {_AREA} / ({_SIZE})))')} AS distance_android, CAST(greatest(32, floor(least(event_id % 1500, 960) / 32.0::DOUBLE + 0.5::DOUBLE) * 32) AS INT) AS side FROM ({fixtures.FRAMES_SQL})"""
SQL["capture_replay_face"] = SQL["capture_replay"].replace("timestamp_ms - s >= 1000", "timestamp_ms - s >= 600").replace("/ 1000.0::DOUBLE", "/ 600.0::DOUBLE")

QUALITY, MOTION = SQL["pix_quality"], SQL["pix_motion"]
_SCANNED = f"FROM ({QUALITY}) q JOIN ({MOTION}) m ON q.image_id = m.event_id"
SQL["scan_frames"] = f"""SELECT session_id, event_id, TRUE AS detected, 'VISA' AS document_type, 16.0::DOUBLE AS frame_width, 12.0::DOUBLE AS frame_height, 0.7::DOUBLE AS confidence, blur_score, brightness, glare_ratio, motion_score,
  0.4::DOUBLE AS distance_ratio, 0.0::DOUBLE AS perspective_skew_deg, 0.0::DOUBLE AS out_of_frame_ratio, 1.6::DOUBLE AS topleft_x, 3.0::DOUBLE AS topleft_y, 14.4::DOUBLE AS bottomright_x, 9.0::DOUBLE AS bottomright_y {_SCANNED}"""
SQL["scan_frames_heatmap"] = """SELECT user_id AS session_id, event_id, TRUE AS detected, 'GENERIC' AS document_type, 16.0::DOUBLE AS frame_width, 12.0::DOUBLE AS frame_height, 0.65::DOUBLE AS confidence,
  2.0::DOUBLE AS topleft_x, 1.5::DOUBLE AS topleft_y, 14.0::DOUBLE AS topright_x, 1.5::DOUBLE AS topright_y, 14.0::DOUBLE AS bottomright_x, 10.5::DOUBLE AS bottomright_y, 2.0::DOUBLE AS bottomleft_x, 10.5::DOUBLE AS bottomleft_y FROM events"""
#: Cell (3, 4) of stride 8 at 64 x 64: centre (36, 28), size 16; 4 and 16 / 3 model pixels are one of the frame.
SQL["scan_faces"] = f"""SELECT session_id, event_id, TRUE AS detected, 16.0::DOUBLE AS frame_width, 12.0::DOUBLE AS frame_height, 0.9::DOUBLE AS confidence, blur_score, brightness, glare_ratio, motion_score,
  7.0::DOUBLE AS box_x, 3.75::DOUBLE AS box_y, 4.0::DOUBLE AS box_width, 3.0::DOUBLE AS box_height, 8.0::DOUBLE AS right_eye_x, {r6("(0.9::DOUBLE + 3) * 8 * 12 / 64")} AS mouth_y {_SCANNED}"""
SQL["read_captures"] = f"""SELECT o_orderkey AS capture_id, 'ID_CARD' AS document_type, substr('ABCDEFG', CAST(1 + (o_orderkey % 8 * 30 + 10) // 30 % 7 AS INT), 1) || ' B' AS text, 1 AS n_lines, {r6("1 / (1 + 8 * exp(-5.0::DOUBLE))")} AS confidence,
  0.0::DOUBLE AS x, 0.184375::DOUBLE AS y, 1.0::DOUBLE AS width, 0.35::DOUBLE AS height, o_orderkey % 2 = 0 AS has_rectified, '' AS error FROM orders"""
SQL["shown_labels"] = f"SELECT event_id, CASE document_type WHEN 'PASSPORT' THEN 'Passport' WHEN 'VISA' THEN 'Visa' WHEN 'ID_CARD' THEN 'ID Card' ELSE 'Document' END AS label, CAST(floor(confidence * 100 + 0.5::DOUBLE) AS BIGINT) AS percent FROM ({fixtures.FRAMES_SQL}) WHERE detected"


def _turned(x: str, y: str) -> tuple[str, str]:
    """A point of a 720 x 1280 buffer turned by its event's orientation, then mirrored."""
    k = "event_id % 4"
    tx = f"CASE {k} WHEN 1 THEN 1280 - {y} WHEN 3 THEN {y} WHEN 2 THEN 720 - {x} ELSE {x} END"
    ty = f"CASE {k} WHEN 1 THEN {x} WHEN 3 THEN 720 - {x} WHEN 2 THEN 1280 - {y} ELSE {y} END"
    return f"CAST(CASE WHEN event_id % 3 = 0 THEN (CASE WHEN {k} % 2 = 1 THEN 1280 ELSE 720 END) - ({tx}) ELSE {tx} END AS DOUBLE)", f"CAST({ty} AS DOUBLE)"


_EYES = [f"{v} AS {eye}eye_{k}" for eye in ("right", "left") for k, v in zip("xy", _turned(f"{eye}_x", f"{eye}_y"), strict=True)]
SQL["g_landmark_orientation"] = f"SELECT event_id, {', '.join(_EYES)} FROM ({fixtures.FACE_FRAMES_SQL}) WHERE detected"
SQL["model_version"] = f"""{REG}, steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
spelled AS (SELECT id, hex(encode(label)) AS h, tab FROM latest CROSS JOIN steps)
SELECT id, id || '@' || lower(format('{{:x}}', xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1]))))) AS version FROM spelled"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
