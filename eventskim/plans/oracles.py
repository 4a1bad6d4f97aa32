"""The queries again in plain SQL, for a second engine to run on the same tables."""

from __future__ import annotations

import re
import zlib

from ..schema import event_key
from .fixtures import VIEWS, stored_sql, view_sql
from .queries import ANGLE_DIGITS, EVENT_RANGE, MERGED_NAME, SAMPLE_GROUPS, SAMPLES, SUM_DIGITS, TAU_ETA, TAU_PT


def _with(groups: list[str], body: str, **more: str) -> str:
    parts = [f"{g} AS (\n{view_sql(g)}\n)" for g in groups]
    parts += [f"{name} AS (\n{sql}\n)" for name, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _matched(left: str, right: str) -> str:
    pairs = zip(event_key(left), event_key(right))
    return " AND ".join(f"{a} IS NOT DISTINCT FROM {b}" for a, b in pairs)


def _with_info(group: str) -> str:
    return f"SELECT * FROM {group} LEFT JOIN Info ON {_matched(group, 'Info')}"


def _top(source: str, group: str, fields: list[str], count: str = "", extra: str = "") -> str:
    keys = ", ".join(event_key(group))
    order = ", ".join(f"{f} DESC NULLS LAST" for f in fields)
    number = f", {count}" if count else ""
    return f"""SELECT {keys}, {", ".join(fields)}{number}{extra} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS place,
         COUNT(*) OVER (PARTITION BY {keys}) AS {count or "rows_of_event"}
  FROM {source}) ranked
WHERE place = 1"""


def _kin(group: str) -> list[str]:
    return [f"{group}_pt", f"{group}_eta", f"{group}_phi"]


def _steps(x: str, edges: list[str], values: list[str]) -> str:
    arms = " ".join(f"WHEN {x} < {e} THEN {v}" for e, v in zip(edges, values))
    return f"CASE {arms} WHEN {x} >= {edges[-1]} THEN {values[-1]} END"


# Effective areas, written out here a second time on purpose.
_E_EDGES = ["0.8", "1.3", "2.0", "2.2", "2.3", "2.4"]
_E_AREAS = ["0.1752", "0.1862", "0.1411", "0.1534", "0.1903", "0.2243", "0.2687"]
_P_EDGES = ["1.0", "1.479", "2.0", "2.2", "2.3", "2.4"]
_P_AREAS = [
    ["0.0157", "0.0143", "0.0115", "0.0094", "0.0095", "0.0068", "0.0053"],
    ["0.0143", "0.0210", "0.0147", "0.0082", "0.0124", "0.0186", "0.0320"],
    ["0.0725", "0.0604", "0.0320", "0.0512", "0.0766", "0.0949", "0.1160"],
]


def _muons(bit: int) -> str:
    return f"""SELECT *, TRUE AS passfilter FROM Muon
WHERE Muon_pt >= 10 AND ABS(Muon_eta) < 2.4 AND (Muon_pogIDBits & {bit}) <> 0
  AND Muon_chHadIso + CASE
        WHEN Muon_neuHadIso + Muon_gammaIso - 0.5 * Muon_puIso > 0
        THEN Muon_neuHadIso + Muon_gammaIso - 0.5 * Muon_puIso ELSE 0 END
      < 0.12 * Muon_pt"""


_TAUS = """SELECT *, TRUE AS passfilter FROM Tau
WHERE Tau_pt >= 10 AND ABS(Tau_eta) < 2.3
  AND (Tau_hpsDisc // 65536) % 2 = 1 AND Tau_rawIso3Hits <= 5"""

_PHOTON_AREA = ", ".join(
    f"rhoIso * ({_steps('Photon_scEta', _P_EDGES, v)}) AS rhoArea{i}"
    for i, v in enumerate(_P_AREAS)
)


def _photon_region(sieie: str, charged: str, neutral: str, gamma: str) -> str:
    def left(raw: str, area: int) -> str:
        return f"GREATEST(Photon_{raw} - rhoArea{area}, 0.0)"

    return f"""(Photon_sieie <= {sieie} OR {left("chHadIso", 0)} <= {charged}
        OR {left("neuHadIso", 1)} <= {neutral} OR {left("gammaIso", 2)} <= {gamma})"""


_PHOTONS = f"""SELECT *, TRUE AS passfilter
FROM (SELECT *, {_PHOTON_AREA} FROM ({_with_info("Photon")}) joined) areas
WHERE Photon_pt >= 175 AND ABS(Photon_eta) < 1.4442
  AND (Photon_sthovere <= 0.05 OR CASE WHEN ABS(Photon_scEta) <= 1.479
    THEN {_photon_region("0.0103", "2.44", "2.57 + EXP(0.0044 * Photon_pt * 0.5809)",
                         "1.92 + 0.0043 * Photon_pt")}
    ELSE {_photon_region("0.0277", "1.84", "4.00 + EXP(0.0040 * Photon_pt * 0.9402)",
                         "2.15 + 0.0041 * Photon_pt")} END)"""


def _electrons(veto: bool = False, pileup: bool = False, area: bool = False) -> str:
    neutral = "Electron_gammaIso + Electron_neuHadIso" + (" - rhoEffarea" if pileup else "")
    keep = "AND Electron_isConv <> 1" if veto else ""
    keep += " AND rhoEffarea IS NOT NULL" if area else ""
    return f"""SELECT *, TRUE AS passfilter1, TRUE AS passfilter2
FROM (SELECT *, Electron_chHadIso + GREATEST({neutral}, 0.0) AS iso
      FROM (SELECT *, rhoIso * ({_steps("Electron_eta", _E_EDGES, _E_AREAS)}) AS rhoEffarea
            FROM ({_with_info("Electron")}) joined) areas) isolated
WHERE Electron_pt >= 10 AND ABS(Electron_eta) < 2.5 {keep}
  AND CASE WHEN ABS(Electron_scEta) < 1.479
    THEN iso < 0.126 * Electron_pt OR ABS(Electron_dEtaIn) < 0.0152
      OR ABS(Electron_dPhiIn) < 0.216 OR Electron_sieie < 0.0114
    ELSE iso < 0.144 * Electron_pt OR ABS(Electron_dEtaIn) < 0.0113
      OR ABS(Electron_dPhiIn) < 0.237 OR Electron_sieie < 0.0352 END
  AND CASE WHEN ABS(Electron_scEta) < 1.479
    THEN Electron_hovere < 0.181 OR ABS(1.0 - Electron_eoverp) < 0.207 * Electron_ecalEnergy
      OR ABS(Electron_d0) < 0.0564 OR ABS(Electron_dz) < 0.472 OR Electron_nMissingHits <= 2
    ELSE Electron_hovere < 0.116 OR ABS(1.0 - Electron_eoverp) < 0.174 * Electron_ecalEnergy
      OR ABS(Electron_d0) < 0.222 OR ABS(Electron_dz) < 0.921 OR Electron_nMissingHits <= 3 END"""


_E_GROUPS = ["Info", "Electron"]


def _electron_filter(**flags: bool) -> str:
    selected = f"SELECT * EXCLUDE (iso) FROM ({_electrons(**flags)}) selected"
    return _with(_E_GROUPS, selected)


def _electron_top(body: str, **flags: bool) -> str:
    top = _top("selected", "Electron", _kin("Electron"))
    return _with(_E_GROUPS, body, selected=_electrons(**flags), top=top)


def _hist(column: str, n: int) -> str:
    return f"""SELECT bucket, lo + bucket * (hi - lo) / {n} AS bucket_lo,
  CASE WHEN bucket = {n} - 1 THEN hi ELSE lo + (bucket + 1) * (hi - lo) / {n} END AS bucket_hi,
  COUNT(*) AS n
FROM (SELECT lo, hi, CAST(LEAST(FLOOR(({column} - lo) / (hi - lo) * {n}), {n} - 1) AS INT) AS bucket
      FROM top, (SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM top) ends) placed
GROUP BY bucket, lo, hi"""


def _dense_hist(column: str, n: int) -> str:
    return f"""SELECT b.bucket, lo + b.bucket * (hi - lo) / {n} AS bucket_lo,
  CASE WHEN b.bucket = {n} - 1 THEN hi ELSE lo + (b.bucket + 1) * (hi - lo) / {n} END AS bucket_hi,
  COALESCE(h.n, 0) AS n
FROM (SELECT CAST(range AS INT) AS bucket FROM range({n})) b
CROSS JOIN (SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM top) ends
LEFT JOIN ({_hist(column, n)}) h ON h.bucket = b.bucket"""


def _jets(source: str, g: str, pt: int, eta: float) -> str:
    return f"""SELECT *, TRUE AS passfilter FROM {source}
WHERE {g}_pt >= {pt} AND ABS({g}_eta) < {eta}
  AND ({g}_neuHadFrac >= 0.99 OR {g}_neuEmFrac >= 0.99 OR {g}_nParticles <= 1
    OR (ABS({g}_eta) < 2.4
        AND ({g}_chHadFrac = 0 OR {g}_nCharged = 0 OR {g}_chEmFrac >= 0.99)))"""


# One projection of both groups from the rows they share.
_BOTH = f"SELECT {VIEWS['CA15Puppi'][0]},{VIEWS['AddCA15Puppi'][0]}\nFROM lineitem"
_DERIVED = """AddCA15Puppi_tau1 / NULLIF(AddCA15Puppi_tau2, 0) AS tau21,
  AddCA15Puppi_tau2 / NULLIF(AddCA15Puppi_tau3, 0) AS tau32,
  LEAST(AddCA15Puppi_sj1_csv, AddCA15Puppi_sj2_csv) AS mincsv,
  GREATEST(AddCA15Puppi_sj1_csv, AddCA15Puppi_sj2_csv, AddCA15Puppi_sj3_csv,
           AddCA15Puppi_sj4_csv) AS maxsubcsv"""
_SPENT = """AddCA15Puppi_tau1, AddCA15Puppi_tau2, AddCA15Puppi_tau3, AddCA15Puppi_sj1_csv,
  AddCA15Puppi_sj2_csv, AddCA15Puppi_sj3_csv, AddCA15Puppi_sj4_csv"""
_ADD_KEY = ", ".join(event_key("AddCA15Puppi"))
_VJETS = _jets(
    f"(SELECT * EXCLUDE ({_SPENT}, {_ADD_KEY}), {_DERIVED} FROM ({_BOTH}) pair) derived",
    "CA15Puppi",
    150,
    2.5,
)
_JETS = _jets(f"({_with_info('AK4Puppi')}) joined", "AK4Puppi", 30, 4.5)
_JET_TOP = _top("jets", "AK4Puppi", [*_kin("AK4Puppi"), "AK4Puppi_csv", "puppETphi"], "N")
_VJET_TOP = _top(
    "vjets",
    "CA15Puppi",
    [
        *_kin("CA15Puppi"),
        "CA15Puppi_mass",
        "CA15Puppi_csv",
        "CA15Puppi_chHadFrac",
        "CA15Puppi_neuHadFrac",
        "CA15Puppi_neuEmFrac",
        "tau21",
        "tau32",
        "mincsv",
        "maxsubcsv",
        "AddCA15Puppi_mass_sd0",
    ],
    "N",
)
_PAIRS = f"""SELECT j.*, v.* EXCLUDE (N), v.N AS N_vjet
FROM jet_top j LEFT JOIN vjet_top v ON {_matched("AK4Puppi", "CA15Puppi")}"""


def _distance(step: str) -> str:
    dphi = "(AK4Puppi_phi - CA15Puppi_phi)"
    return f"""SQRT(POWER(AK4Puppi_eta - CA15Puppi_eta, 2) + POWER(CASE
    WHEN {dphi} >= PI() THEN {dphi} - {step} WHEN {dphi} < -PI() THEN {dphi} + {step}
    ELSE {dphi} END, 2))"""


_ANGLE = "ACOS(COS(puppETphi - AK4Puppi_phi))"
_MEASURED = f"""SELECT *, CAST(COALESCE({_ANGLE}, 999.99) AS DOUBLE) AS mindPhi,
  CAST(CASE WHEN puppETphi > 0 THEN {_ANGLE} ELSE 999.99 END AS DOUBLE) AS mindFPhi,
  {_distance("PI()")} AS deltaR
FROM pairs"""


def _round(column: str) -> str:
    return f"ROUND({column}, {ANGLE_DIGITS}) AS {column}"


_ROUNDED = f"* REPLACE ({', '.join(map(_round, ('mindPhi', 'mindFPhi', 'deltaR')))})"


def _jet_query(body: str) -> str:
    return _with(
        ["Info", "AK4Puppi"],
        body,
        jets=_JETS,
        vjets=_VJETS,
        jet_top=_JET_TOP,
        vjet_top=_VJET_TOP,
        pairs=_PAIRS,
        measured=_MEASURED,
    )


_KEYS = ", ".join(event_key("AK4Puppi"))
_COUNTS = _jet_query(
    f"""SELECT {_ROUNDED} FROM measured
JOIN (SELECT {_KEYS}, COUNT(*) AS NdR15 FROM measured WHERE deltaR > 1.5 GROUP BY {_KEYS}) far
  USING ({_KEYS})
JOIN (SELECT {_KEYS}, COUNT(*) AS NbtagLdR15 FROM measured
      WHERE deltaR > 1.5 AND ABS(AK4Puppi_eta) < 2.5 AND AK4Puppi_csv > 0.605
      GROUP BY {_KEYS}) tagged USING ({_KEYS})"""
)

_SUMMED = {
    "Info": "runNum lumiSec evtNum rhoIso metFilterFailBits pfMET pfMETphi puppET puppETphi",
    "GenEvtInfo": "runNum lumiSec evtNum weight scalePDF",
}


def _columns(group: str) -> list[str]:
    if group in _SUMMED:
        return _SUMMED[group].split()
    text = VIEWS[group][0]
    return [w.strip(",") for w in text.split() if w.startswith(f"{group}_")]


def _sums(group: str, total: str = f"ROUND(CAST(SUM({{}}) AS DOUBLE), {SUM_DIGITS})") -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{group}' AS "group", '{c}' AS dataset, {total.format(c)} AS total FROM {group}"""
        for c in _columns(group)
    )


def _exact_sums(group: str) -> str:
    """Sums as whole multiples of 2^-64, of which the leading bits are rounded once.

    A last bit stands for all bits beyond the 59 that are kept.
    """
    parts = "\nUNION ALL ".join(
        f"""SELECT '{group}' AS "group", '{c}' AS dataset, SUM(CAST(CAST({c} AS DOUBLE) * pow(2, 64) AS HUGEINT)) AS t FROM {group}"""
        for c in _columns(group)
    )
    return f"""SELECT "group", dataset, CASE WHEN t = 0 THEN CAST(0 AS DOUBLE)
    ELSE sign(t) * CAST(CAST(2 * (abs(t) // unit) + CASE WHEN abs(t) % unit = 0 THEN 0 ELSE 1 END AS BIGINT) AS DOUBLE)
      * pow(2, k - 65) END AS total
FROM (SELECT *, CAST(pow(2, k) AS HUGEINT) AS unit
  FROM (SELECT *, CASE WHEN t = 0 THEN 0 ELSE greatest(0, CAST(floor(log2(CAST(abs(t) AS DOUBLE))) AS INT) - 58) END AS k
    FROM ({parts}) sums) scaled) units"""


def _crc(text: str) -> int:
    return zlib.crc32(text.encode())


def _tags(name: str) -> str:
    return (
        f"CAST({_crc(name.split('_')[0])} AS BIGINT) AS stype, CAST({_crc(name)} AS BIGINT) AS snum"
    )


def _one(group: str, columns: str = "*", rest: str = "") -> str:
    return _with([group], f"SELECT {columns} FROM {group} {rest}")


def _stored(groups: list[str], body: str) -> str:
    """``body`` over groups of the catalogue's types; its constants are doubles, as they are in Spark."""
    parts = [f"{g} AS (\n{stored_sql(g)}\n)" for g in groups]
    body = re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", lambda m: f"CAST({m[0]} AS DOUBLE)", body)
    return "WITH " + ",\n".join(parts) + "\n" + body


_RANGE = _one(
    "Electron",
    "Electron_evtNum, Electron_pt, Electron_eta",
    f"WHERE Electron_evtNum >= {EVENT_RANGE[0]} AND Electron_evtNum < {EVENT_RANGE[1]}",
)


def _tag_counts(group: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT {_tags(name)}, COUNT(*) AS n, '{group}' AS "group" FROM {group}
WHERE {event_key(group)[2]} % 2 = {k}"""
        for k, name in enumerate(SAMPLES)
    )


#: Muons as files of three formats hold them.
_UNLIKE = """SELECT * REPLACE (
    CASE WHEN Muon_evtNum % 3 = 1 THEN CAST(CAST(Muon_eta AS REAL) AS DOUBLE) ELSE Muon_eta END AS Muon_eta,
    CASE WHEN Muon_evtNum % 3 <> 1 THEN Muon_gammaIso END AS Muon_gammaIso)
FROM whole"""


def _unlike(body: str) -> str:
    return f"WITH whole AS (\n{view_sql('Muon')}\n), Muon AS (\n{_UNLIKE}\n)\n{body}"


_AREA = f"CAST({_steps('Electron_eta', _E_EDGES, _E_AREAS)} AS DOUBLE) AS area"


_HISTOGRAMS =         _electron_top(
            f"""SELECT 'Electron_pt' AS "column", * FROM ({_hist("Electron_pt", 1000)}) a
UNION ALL SELECT 'Electron_eta' AS "column", * FROM ({_hist("Electron_eta", 5)}) b"""
        )


def oracle_sql() -> dict[str, str]:
    return {
        "scan_muon": _one("Muon"),
        "scan_tau": _one("Tau"),
        "scan_photon": _one("Photon"),
        "scan_electron": _one("Electron"),
        "scan_info": _one("Info"),
        "scan_genevt": _one("GenEvtInfo"),
        "scan_jet": _one("AK4Puppi"),
        "scan_vjet": _one("CA15Puppi"),
        "scan_addvjet": _one("AddCA15Puppi"),
        **{f"read_group_{g.lower()}": stored_sql(g) for g in VIEWS},
        "float_muon_filter": _stored(["Muon"], _muons(1)),
        "float_tau_filter": _stored(["Tau"], _TAUS),
        "float_photon_filter": _stored(["Info", "Photon"], _PHOTONS),
        "float_electron_filter": _stored(["Info", "Electron"], f"SELECT * EXCLUDE (iso) FROM ({_electrons()}) selected"),
        "float_jet_filter": _stored(["Info", "AK4Puppi"], _JETS),
        "float_vjet_cut": _stored(["CA15Puppi"], _jets("CA15Puppi", "CA15Puppi", 150, 2.5)),
        "schemas_of_paths": _stored(["Photon"], "SELECT Photon_evtNum, Photon_pt, Photon_eta FROM Photon"),
        "merge_sample_tags": _with(list(SAMPLE_GROUPS), "\nUNION ALL ".join(map(_tag_counts, SAMPLE_GROUPS))),
        "merge_sample_rows": _with(
            ["GenEvtInfo"],
            "\nUNION ALL ".join(
                f"SELECT *, {_tags(name)} FROM GenEvtInfo WHERE evtNum % 2 = {k}" for k, name in enumerate(SAMPLES)
            ),
        ),
        "merge_sample_twice": _with(
            ["GenEvtInfo"],
            "\nUNION ALL ".join(
                f"SELECT *, {_tags(name)} FROM GenEvtInfo WHERE evtNum % 2 = {k}" for k, name in enumerate(SAMPLES)
            ),
        ),
        "merge_sample_target_tags": _one("Muon", f"Muon_evtNum, Muon_pt, {_tags(MERGED_NAME)}"),
        "sums_of_root": _with(list(SAMPLE_GROUPS), "\nUNION ALL ".join(map(_sums, SAMPLE_GROUPS))),
        "scan_unlike_files": _unlike("SELECT * FROM Muon"),
        "read_columns_of_unlike_files": _unlike("SELECT Muon_evtNum, Muon_eta, Muon_pogIDBits FROM Muon"),
        "sums_of_unlike_files": _unlike(_sums("Muon")),
        "row_index_of_any_table": """SELECT n, 0::BIGINT AS least, n - 1 AS largest,
  CAST(n * (n - 1) / 2 AS DOUBLE) AS total, n AS distinct_numbers
FROM (SELECT COUNT(*) AS n FROM orders) counted""",
        "row_index_of_all_orders": "SELECT o_orderkey, o_custkey, TRUE AS numbered FROM orders",
        "read_group_by_run": _one(
            "Electron",
            "Electron_runNum, Electron_lumisec, Electron_evtNum, Electron_pt, Electron_isConv",
        ),
        "scan_dynamic_group": _one("Tau"),
        "read_columns_of_group": _one("Photon", "Photon_evtNum, Photon_pt, Photon_eta"),
        "scan_colgroup": _one("Muon"),
        "scan_colgroup_columns": _one("Electron", "Electron_evtNum, Electron_pt, Electron_isConv"),
        "scan_arrays_format": _one("Electron"),
        "scan_arrays_range": _RANGE,
        "scan_arrays_pushed": _RANGE,
        "vjet_filter_arrays_format": _VJETS,
        "vjet_filter_paired": _VJETS,
        "vjet_leading_paired": f"WITH vjets AS ({_VJETS})\n{_VJET_TOP}",
        "merge_groups_by_run": _one("GenEvtInfo"),
        "merge_job": _one("Info", f"*, {_tags(MERGED_NAME)}"),
        "provenance_tags": f"SELECT o_orderkey, {_tags('orders')} FROM orders",
        "muon_filter": _with(["Muon"], _muons(1)),
        "muon_filter_tight": _with(["Muon"], _muons(2)),
        "muon_filter_udf": _with(["Muon"], _muons(1)),
        "muon_leading": _with(
            ["Muon"],
            _top("muons", "Muon", _kin("Muon"), extra=", CAST(0.105658369 AS DOUBLE) AS Muon_Mass"),
            muons=_muons(1),
        ),
        "tau_filter": _with(["Tau"], _TAUS),
        "tau_leading": _with(["Tau"], _top("taus", "Tau", _kin("Tau")), taus=_TAUS),
        "electron_filter": _electron_filter(),
        "electron_filter_udf_form": _electron_filter(pileup=True, area=True),
        "electron_filter_pandas_form": _electron_filter(veto=True),
        "electron_filter_pandas_sql_form": _electron_filter(veto=True, pileup=True),
        "electron_leading": _electron_top("SELECT * FROM top"),
        "electron_leading_pileup": _electron_top("SELECT * FROM top", pileup=True),
        "electron_leading_pileup_split": _electron_top("SELECT * FROM top", pileup=True),
        "electron_leading_sql": _electron_top("SELECT * FROM top", pileup=True),
        "muon_leading_sql": _with(
            ["Muon"],
            _top("muons", "Muon", _kin("Muon"), extra=", CAST(0.105658369 AS DOUBLE) AS Muon_Mass"),
            muons=_muons(1),
        ),
        "jet_selection_sql": _with(["AK4Puppi"], f"SELECT * EXCLUDE (passfilter) FROM ({_jets('AK4Puppi', 'AK4Puppi', 30, 4.5)}) jets"),
        "electron_count": _electron_top("SELECT COUNT(*) AS n FROM top"),
        "electron_pt_range": _electron_top(
            "SELECT MIN(Electron_pt) AS min_value, MAX(Electron_pt) AS max_value FROM top"
        ),
        "hist_electron_pt": _electron_top(_hist("Electron_pt", 1000)),
        "hist_electron_eta": _electron_top(_hist("Electron_eta", 5)),
        "hist_electron_pt_dense": _electron_top(_dense_hist("Electron_pt", 1000)),
        "electron_histograms": _HISTOGRAMS,
        "histogram_file": _HISTOGRAMS,
        "effective_area_lookup": _one("Electron", f"Electron_evtNum, Electron_eta, {_AREA}"),
        "step_lookup_range_join": _one("Electron", f"Electron_evtNum, Electron_eta, {_AREA}"),
        "photon_filter": _with(["Info", "Photon"], _PHOTONS),
        "photon_leading": _with(
            ["Info", "Photon"],
            _top(f"({_with_info('Photon')}) joined", "Photon", _kin("Photon"), "NMedium"),
        ),
        "photon_leading_filtered": _with(
            ["Info", "Photon"],
            _top("photons", "Photon", _kin("Photon"), "NMedium"),
            photons=_PHOTONS,
        ),
        "jet_filter": _with(
            ["Info", "AK4Puppi"],
            "SELECT * EXCLUDE (passfilter, AK4Puppi_nParticles, AK4Puppi_nCharged, "
            f"AK4Puppi_chEmFrac) FROM ({_JETS}) jets",
        ),
        "jet_leading": _jet_query("SELECT * FROM jet_top"),
        "addvjet_derived": _one("AddCA15Puppi", f"* EXCLUDE ({_SPENT}), {_DERIVED}"),
        "vjet_zip": _BOTH,
        "vjet_zip_left": _BOTH,
        "vjet_cut": _with(["CA15Puppi"], _jets("CA15Puppi", "CA15Puppi", 150, 2.5)),
        "vjet_filter": _VJETS,
        "vjet_filter_aligned_scan": _VJETS,
        "vjet_leading": f"WITH vjets AS ({_VJETS})\n{_VJET_TOP}",
        "jet_vjet_join": _jet_query("SELECT * FROM pairs"),
        "jet_vjet_deltar": _jet_query(f"SELECT {_ROUNDED} FROM measured"),
        "jet_vjet_deltar_2pi": _jet_query(
            f"SELECT {_KEYS}, ROUND({_distance('2 * PI()')}, {ANGLE_DIGITS}) AS deltaR FROM pairs"
        ),
        "jet_counts": _COUNTS,
        "jet_counts_joined": _COUNTS,
        "tau_counts": _with(
            ["Tau"],
            f"""SELECT * FROM (SELECT *, COUNT(*) FILTER (WHERE Tau_pt > {TAU_PT}) OVER event AS n_high,
    COUNT(*) FILTER (WHERE Tau_pt > {TAU_PT} AND ABS(Tau_eta) < {TAU_ETA}) OVER event AS n_barrel
  FROM Tau WINDOW event AS (PARTITION BY {', '.join(event_key("Tau"))})) counted
WHERE n_high > 0 AND n_barrel > 0""",
        ),
        "row_index": """SELECT l_orderkey, l_partkey, l_linenumber,
  ROW_NUMBER() OVER () - 1 AS _index FROM lineitem""",
        "event_count": _one("GenEvtInfo", "COUNT(*) AS n_events"),
        "sum_of_weights": _one(
            "GenEvtInfo", "SUM(weight) AS sum_weight, COUNT(*) AS n_events"
        ),
        "column_sums_of_groups": _with(list(VIEWS), "\nUNION ALL ".join(map(_sums, VIEWS))),
        "exact_sums_of_groups": _with(list(VIEWS), "\nUNION ALL ".join(map(_exact_sums, VIEWS))),
        "sums_of_arrays": _with(list(SAMPLE_GROUPS), "\nUNION ALL ".join(map(_exact_sums, SAMPLE_GROUPS))),
        "exact_weight_sums": _with(
            ["GenEvtInfo"],
            _sums("GenEvtInfo", "CAST(SUM(CAST({} AS DECIMAL(28, 4))) AS DOUBLE)"),
        ),
        "met_preselect": _one("Info", rest="WHERE pfMET > 200 OR puppET > 200"),
    }
