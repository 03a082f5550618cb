"""Independent SQL for every query that SQL can express.

The statements follow the plain definition of each operator (pairwise joins,
set unions, one row pair at a time), not the rewrites used on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from contagia.catalog.queries import CLIP_NORM, LINEAR_INTERCEPT, LINEAR_WEIGHTS, SEED
from contagia.operators.flat import FLAT_FEATURES
from contagia.params import RunParams
from contagia.plans import master

W = 2  # window of the standard runs
HASH = "((pid % 1000003) * 2654435761) % 1000003"

BASE = {
    "person": """
        SELECT c_custkey AS pid, c_custkey // 4 AS hid, c_custkey % 4 + 1 AS person_number,
               CAST(floor(abs(c_acctbal)) AS BIGINT) % 90 AS age,
               CAST(c_nationkey % 2 + 1 AS BIGINT) AS sex,
               CAST(n_regionkey AS BIGINT) AS client_id
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "states": """
        SELECT p.client_id, CAST(d.day AS BIGINT) AS day, p.pid,
               CASE WHEN d.day >= p.onset + p.len THEN 'R'
                    WHEN d.day >= p.onset AND p.pid % 5 <> 0 THEN 'I' ELSE 'S' END AS state
        FROM (SELECT *, (hid * 37 + (pid * 7) % 11) % 90 AS onset, 3 + age % 7 + sex AS len
              FROM person) p, (SELECT unnest(range(63)) AS day) d""",
    "bought": """
        SELECT o_orderkey, o_custkey AS pid, l_partkey AS lid,
               CAST(l_linenumber AS BIGINT) * 3600 AS start_time,
               CAST(l_quantity * 60 AS BIGINT) AS duration, CAST(l_linenumber AS BIGINT) AS act
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "visits": "SELECT pid, lid, start_time, duration FROM bought",
    "edges": """
        SELECT p.client_id, least(b.pid, o.o_custkey) AS pid1, greatest(b.pid, o.o_custkey) AS pid2,
               b.lid, b.start_time, b.duration, b.act AS activity1, b.act % 3 AS activity2
        FROM bought b JOIN orders o ON o.o_orderkey = b.o_orderkey + 1
             JOIN person p ON p.pid = least(b.pid, o.o_custkey)
        WHERE b.pid <> o.o_custkey""",
    "picked": "SELECT pid, CAST(49 AS BIGINT) AS first_day FROM person WHERE age >= 60",
}


def _cohort_ctes(end: int, fixed: int, w: int, look: int, extra: bool) -> dict[str, str]:
    low = end - look - w
    extra_rows = (
        """ UNION SELECT pid, first_day, first_day + {look} AS last_day, 2 AS sym FROM picked x
            WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.pid = x.pid)""".format(look=look)
        if extra
        else ""
    )
    return {
        "recovered": f"""
            SELECT s.pid, min(s.day) AS last_day, f.first_day
            FROM states s JOIN (SELECT pid, min(day) AS first_day FROM states
                                WHERE state = 'I' GROUP BY pid) f
                 ON f.pid = s.pid AND s.day >= f.first_day
            WHERE s.state = 'R' AND f.first_day <= {fixed}
            GROUP BY s.pid, f.first_day HAVING min(s.day) <= {fixed}""",
        "silent": f"""
            SELECT s.pid, min(s.day) AS last_day FROM states s
            WHERE s.state = 'R' AND NOT EXISTS (SELECT 1 FROM recovered r WHERE r.pid = s.pid)
            GROUP BY s.pid HAVING min(s.day) <= {fixed}""",
        "silent_dated": "SELECT pid, last_day - 2 AS first_day, last_day FROM silent",
        "known": f"""
            SELECT pid, min(day) AS first_day, max(day) AS last_day, CAST(1 AS BIGINT) AS sym
            FROM states WHERE state = 'I' GROUP BY pid HAVING min(day) <= {fixed}
            UNION
            SELECT pid, first_day, last_day, CAST(0 AS BIGINT) FROM silent_dated
            WHERE first_day <= {fixed}""",
        "merged": "SELECT pid, first_day, last_day, sym FROM known" + extra_rows,
        "spans": "SELECT DISTINCT pid, first_day, last_day FROM merged",
        "healthy": f"""
            SELECT pid, CAST({end - look} AS BIGINT) AS last_day, CAST({low} AS BIGINT) AS first_day
            FROM person p WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.pid = p.pid)""",
        "healthy_now": f"""
            SELECT pid, CAST({end} AS BIGINT) AS last_day, CAST({end - w} AS BIGINT) AS first_day
            FROM person p WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.pid = p.pid)""",
    }


def _pairs(subject: str, infected: str, on: str, w: int, extra: str = "", measure: str = "") -> str:
    """Subject-by-infected pairs whose interval touches the subject's window."""
    return f"""
        SELECT a.pid, a.till AS window_end, greatest(b.first_day, a.till - {w}) AS max_end,
               least(b.last_day, a.till) AS min_end{measure}
        FROM {subject} a JOIN {infected} b
             ON {on} AND b.first_day <= a.till AND b.last_day >= a.till - {w}{extra}"""


def _exposure_ctes(end: int, w: int, look: int) -> dict[str, str]:
    bounds = "pid, window_end, max_end, min_end"

    def contact_side(me: int, you: int, window_end: str, who: str) -> str:
        f, l = f"first_dat_pid{you}", f"last_dat_pid{you}"
        return f"""
            SELECT pid{me} AS pid, {window_end} AS window_end,
                   greatest({f}, {window_end} - {w}) AS max_end, least({l}, {window_end}) AS min_end,
                   CAST(sum(total_interactions) AS BIGINT) AS total_interactions
            FROM contacts
            WHERE {who} AND {f} <= {window_end} AND {l} >= {window_end} - {w}
            GROUP BY ALL"""

    def contact_merge(a: str, b: str) -> str:
        return f"""
            SELECT {bounds}, CAST(sum(total_interactions) AS BIGINT) AS total_interactions
            FROM (SELECT * FROM {a} UNION SELECT * FROM {b}) GROUP BY {bounds}"""

    def counted(pairs: str, name: str, minutes: bool = False) -> str:
        more = ", CAST(sum(minutes) AS BIGINT) AS sum_infected_duration" if minutes else ""
        return f"SELECT {bounds}, count(*) AS {name}{more} FROM {pairs} GROUP BY {bounds}"

    ctes = {
        "contacts": """
            SELECT e.pid1, e.pid2, x.first_day AS first_dat_pid1, x.last_day AS last_dat_pid1,
                   y.first_day AS first_dat_pid2, y.last_day AS last_dat_pid2,
                   count(*) AS total_interactions
            FROM edges e LEFT JOIN spans x ON x.pid = e.pid1 LEFT JOIN spans y ON y.pid = e.pid2
            GROUP BY ALL""",
    }
    for tag, till in (("ill", None), ("well", end - look), ("now", end)):
        for me, you in ((1, 2), (2, 1)):
            own = f"first_dat_pid{me}"
            window_end = own if till is None else f"CAST({till} AS BIGINT)"
            who = f"{own} IS NOT NULL" if till is None else f"{own} IS NULL"
            ctes[f"contact_{tag}{me}"] = contact_side(me, you, window_end, who)
        ctes[f"contact_{tag}"] = contact_merge(f"contact_{tag}1", f"contact_{tag}2")
    ctes["contact_all"] = "SELECT * FROM contact_ill UNION SELECT * FROM contact_well"

    ctes["stay_ill"] = """SELECT v.*, c.first_day, c.last_day, c.first_day AS till
                          FROM visits v JOIN spans c ON c.pid = v.pid"""
    ctes["stay_well"] = """SELECT v.*, h.first_day, h.last_day, h.last_day AS till
                           FROM visits v JOIN healthy h ON h.pid = v.pid"""
    ctes["stay_now"] = """SELECT v.*, h.first_day, h.last_day, h.last_day AS till
                          FROM visits v JOIN healthy_now h ON h.pid = v.pid"""
    ctes["home_ill"] = """SELECT p.*, c.first_day, c.last_day, c.first_day AS till
                          FROM person p JOIN spans c ON c.pid = p.pid"""
    ctes["home_well"] = "SELECT p.*, h.last_day AS till FROM person p JOIN healthy h ON h.pid = p.pid"
    ctes["home_now"] = "SELECT p.*, h.last_day AS till FROM person p JOIN healthy_now h ON h.pid = p.pid"
    for tag in ("ill", "well", "now"):
        ctes[f"place_pairs_{tag}"] = _pairs(
            f"stay_{tag}", "stay_ill", "a.lid = b.lid", w, " AND a.pid <> b.pid",
            ", b.duration AS minutes",
        )
        ctes[f"place_{tag}"] = counted(f"place_pairs_{tag}", "total_interaction", True)
        ctes[f"home_pairs_{tag}"] = _pairs(
            f"home_{tag}", "home_ill", "a.hid = b.hid", w, " AND a.pid <> b.pid"
        )
        ctes[f"family_{tag}"] = counted(f"home_pairs_{tag}", "family_infected")
    ctes["place_all"] = "SELECT * FROM place_ill UNION SELECT * FROM place_well"
    ctes["family_all"] = "SELECT * FROM family_ill UNION SELECT * FROM family_well"

    for source, measure, name in (
        ("contact", "total_interactions", "infected_interactions"),
        ("place", "total_interaction", "infected_interactions_loc"),
        ("family", "family_infected", "family_infected"),
    ):
        for tag in ("all", "now", "ill"):
            lags = ", ".join(
                f"CAST(sum(CASE WHEN window_end - {d} >= max_end AND window_end - {d} <= min_end "
                f"THEN {measure} ELSE 0 END) AS BIGINT) AS {name}_lag_day_{d}"
                for d in range(w)
            )
            ctes[f"{source}_lags_{tag}"] = f"SELECT pid, {lags} FROM {source}_{tag} GROUP BY pid"
    for tag in ("all", "now"):
        columns = ", ".join(
            f"{name}_lag_day_{d}"
            for name in ("infected_interactions", "infected_interactions_loc", "family_infected")
            for d in range(w)
        )
        ctes[f"features_{tag}"] = f"""
            SELECT p.pid, p.age, p.sex, {columns} FROM person p
            LEFT JOIN contact_lags_{tag} x ON x.pid = p.pid
            LEFT JOIN place_lags_{tag} y ON y.pid = p.pid
            LEFT JOIN family_lags_{tag} z ON z.pid = p.pid"""
    return ctes


def _label_ctes(end: int, fixed: int) -> dict[str, str]:
    return {
        "train_labels": f"""
            SELECT DISTINCT pid, CAST(1 AS BIGINT) AS covid FROM spans WHERE first_day <= {fixed}
            UNION SELECT pid, CAST(0 AS BIGINT) FROM healthy""",
        "cases": f"""
            SELECT pid, CAST(1 AS BIGINT) AS covid FROM states WHERE state <> 'S'
            GROUP BY pid HAVING min(day) = {end}""",
        "ahead_labels": """
            SELECT DISTINCT pid, CAST(0 AS BIGINT) AS covid FROM healthy h
            WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.pid = h.pid)""",
        "test_labels": """
            SELECT pid, covid FROM cases c
            WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.pid = c.pid)
            UNION SELECT pid, covid FROM ahead_labels""",
        "master_train": "SELECT f.*, l.covid FROM features_all f JOIN train_labels l ON l.pid = f.pid",
        "master_test": "SELECT f.*, l.covid FROM features_all f JOIN test_labels l ON l.pid = f.pid",
        "master_ahead": "SELECT f.*, l.covid FROM features_now f JOIN ahead_labels l ON l.pid = f.pid",
    }


def _linear_score() -> str:
    terms = [f"({v!r}) * coalesce({c}, 0)" for c, v in LINEAR_WEIGHTS.items()]
    return f"1 / (1 + exp(-(CAST({LINEAR_INTERCEPT!r} AS DOUBLE) + {' + '.join(terms)})))"


def _scored_ctes() -> dict[str, str]:
    scored = f"SELECT *, {_linear_score()} AS score FROM "
    return {"scored_test": scored + "master_test", "scored_ahead": scored + "master_ahead"}


def run_ctes(end: int = 49, fixed: int = 49, w: int = W, look: int = 5, extra: bool = False) -> dict[str, str]:
    return {
        **BASE,
        **_cohort_ctes(end, fixed, w, look, extra),
        **_exposure_ctes(end, w, look),
        **_label_ctes(end, fixed),
        **(_scored_ctes() if w == W else {}),
    }


def _flat_ctes(end: int, fixed: int, training: bool, client: bool, w: int = W) -> dict[str, str]:
    """Flat features; with `client` every table is restricted to rows of the same client."""
    k = "client_id, " if client else ""

    def same(a: str, b: str) -> str:
        return f" AND {a}.client_id = {b}.client_id" if client else ""

    def counts(source: str) -> str:
        return f"""
            SELECT {k}pid, CAST(sum(met) AS BIGINT) AS total_pat, CAST(sum(ill) AS BIGINT) AS infect_pat
            FROM (SELECT {k}pid1 AS pid, count(infect_p1) AS met, coalesce(sum(infect_p2), 0) AS ill
                  FROM {source} GROUP BY {k}pid1
                  UNION ALL
                  SELECT {k}pid2, count(infect_p2), coalesce(sum(infect_p1), 0)
                  FROM {source} GROUP BY {k}pid2)
            GROUP BY {k}pid"""

    def places(source: str) -> str:
        return f"""
            SELECT {k}lid, CAST(coalesce(sum(ill), 0) AS BIGINT) AS loc_infect_pat
            FROM (SELECT {k}lid, sum(infect_p1) AS ill
                  FROM (SELECT DISTINCT {k}lid, pid1, infect_p1 FROM {source}) GROUP BY {k}lid
                  UNION ALL
                  SELECT {k}lid, sum(infect_p2)
                  FROM (SELECT DISTINCT {k}lid, pid2, infect_p2 FROM {source}) GROUP BY {k}lid)
            GROUP BY {k}lid"""

    def person_places(source: str, place: str) -> str:
        columns = "q.client_id, q.pid" if client else "q.pid"
        return f"""
            SELECT {columns}, CAST(sum(t.loc_infect_pat) AS BIGINT) AS loc_infect_pat
            FROM (SELECT {k}lid, pid1 AS pid FROM {source} UNION SELECT {k}lid, pid2 FROM {source}) q
            LEFT JOIN {place} t ON t.lid = q.lid{same("t", "q")} GROUP BY {columns}"""

    def features(tag: str, keep: str) -> str:
        return f"""
            SELECT c.*, l.loc_infect_pat FROM counts_{tag} c
            LEFT JOIN person_places_{tag} l ON l.pid = c.pid{same("l", "c")} WHERE {keep}"""

    first = "c.client_id, c.pid" if client else "c.pid"
    rows = f"SELECT {first}, total_pat, infect_pat, loc_infect_pat, 0 AS covid FROM features_recent c"
    if training:
        rows += (
            f" UNION ALL SELECT {first}, total_pat, infect_pat, loc_infect_pat, 1"
            " FROM features_onset c"
        )
    partition = "p.client_id, p.hid" if client else "p.hid"
    out = "p.client_id, p.pid" if client else "p.pid"
    ctes = {
        "affected": f"""
            SELECT {k}pid, min(day) AS day FROM states
            WHERE state IN ('I', 'R') AND day >= {w - 1} GROUP BY {k}pid""",
        "meetings": f"SELECT DISTINCT {k}pid1, pid2, lid FROM edges",
        "meeting_days": f"""
            SELECT m.*, coalesce(x.day, -1) AS day_p1, coalesce(y.day, -1) AS day_p2
            FROM meetings m LEFT JOIN affected x ON x.pid = m.pid1{same("x", "m")}
                 LEFT JOIN affected y ON y.pid = m.pid2{same("y", "m")}""",
        "flags_onset": f"""
            SELECT *, CAST(day_p2 >= 0 AND day_p1 - day_p2 BETWEEN 1 AND {w} AS BIGINT) AS infect_p2,
                   CAST(day_p1 >= 0 AND day_p2 - day_p1 BETWEEN 1 AND {w} AS BIGINT) AS infect_p1
            FROM meeting_days""",
        "recent": f"""
            SELECT {k}pid, CAST(EXISTS (
                       SELECT 1 FROM states s WHERE s.pid = p.pid AND s.state <> 'S'{same("s", "p")}
                       AND s.day >= {fixed - 2 * w} AND s.day < {end - w}) AS BIGINT) AS infect
            FROM person p""",
        "flags_recent": f"""
            SELECT m.*, x.infect AS infect_p1, y.infect AS infect_p2
            FROM meetings m LEFT JOIN recent x ON x.pid = m.pid1{same("x", "m")}
                 LEFT JOIN recent y ON y.pid = m.pid2{same("y", "m")}""",
    }
    for tag in ("onset", "recent"):
        ctes[f"counts_{tag}"] = counts(f"flags_{tag}")
        ctes[f"places_{tag}"] = places(f"flags_{tag}")
        ctes[f"person_places_{tag}"] = person_places(f"flags_{tag}", f"places_{tag}")
    ctes["features_onset"] = features(
        "onset", f"EXISTS (SELECT 1 FROM affected a WHERE a.pid = c.pid{same('a', 'c')})"
    )
    ctes["features_recent"] = features(
        "recent",
        f"NOT EXISTS (SELECT 1 FROM states s WHERE s.pid = c.pid AND s.state <> 'S'{same('s', 'c')})",
    )
    ctes["feature_rows"] = rows
    ctes["flat"] = f"""
        SELECT {out}, coalesce(f.total_pat, 0) AS total_pat, coalesce(f.infect_pat, 0) AS infect_pat,
               coalesce(f.loc_infect_pat, 0) AS loc_infect_pat,
               CAST(coalesce(f.covid, 0) AS BIGINT) AS covid, p.age, p.sex,
               CAST(sum(coalesce(f.infect_pat, 0)) OVER (PARTITION BY {partition}) AS BIGINT)
                   AS family_infect
        FROM person p LEFT JOIN feature_rows f ON f.pid = p.pid{same("f", "p")}"""
    ctes["rated"] = f"""
        SELECT {k}pid, covid, round(1 / (1 + exp(-(CAST(0.8 AS DOUBLE) - CAST(0.05 AS DOUBLE) * infect_pat
               + CAST(0.002 AS DOUBLE) * family_infect))), 6) AS score FROM flat"""
    return ctes


def flat_ctes(end: int = 49, fixed: int = 49, training: bool = True, client: bool = False) -> dict[str, str]:
    return {**BASE, **_flat_ctes(end, fixed, training, client)}


def _needed(ctes: dict[str, str], text: str) -> list[str]:
    """The CTEs a statement uses, in definition order (later ones only use earlier ones)."""
    import re

    used: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in ctes:
            if name in words and name not in used:
                used.add(name)
                todo.append(ctes[name])
    return [name for name in ctes if name in used]


def _suffixed(ctes: dict[str, str], suffix: str) -> dict[str, str]:
    """The same CTEs under other names, for two runs in one statement."""
    import re

    names = "|".join(sorted(ctes, key=len, reverse=True))
    return {k + suffix: re.sub(rf"(FROM|JOIN|, )(\s*\(?\s*)({names})\b(?!\s*\.)", rf"\1\2\3{suffix}", v) for k, v in ctes.items()}


def statement(ctes: dict[str, str], select: str) -> str:
    parts = [f"{name} AS ({ctes[name]})" for name in _needed(ctes, select)]
    return f"WITH {', '.join(parts)} {select}"


# ------------------------------------------------------------------ regression

_X = ("sex", "age", "total_family_members")


def _det(m: Sequence[Sequence[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h}) - {b}*({d}*{i}-{f}*{g}) + {c}*({d}*{h}-{e}*{g}))"


def _regression_ctes() -> dict[str, str]:
    """Least squares on three features by Cramer's rule on the covariances."""
    cov = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    moments = [
        f"covar_pop(CAST({_X[i]} AS DOUBLE), CAST({_X[j]} AS DOUBLE)) AS c{i}{j}"
        for i in range(3) for j in range(i, 3)
    ]
    moments += [f"covar_pop(CAST({x} AS DOUBLE), CAST(recovery_time AS DOUBLE)) AS y{i}"
                for i, x in enumerate(_X)]
    moments += [f"avg({x}) AS m{i}" for i, x in enumerate(_X)] + ["avg(recovery_time) AS my"]
    slopes = []
    for k in range(3):
        replaced = [[f"y{i}" if j == k else cov[i][j] for j in range(3)] for i in range(3)]
        slopes.append(f"{_det(replaced)} / {_det(cov)} AS b{k}")
    return {
        "ill_features": """
            SELECT p.pid, sex, age, person_number,
                   max(person_number) OVER (PARTITION BY hid) AS total_family_members,
                   r.last_day - r.first_day AS recovery_time
            FROM person p JOIN recovered r ON r.pid = p.pid""",
        "silent_features": """
            SELECT p.pid, sex, age, person_number,
                   max(person_number) OVER (PARTITION BY hid) AS total_family_members, s.last_day
            FROM person p JOIN silent s ON s.pid = p.pid""",
        "halved": f"""
            SELECT *, CAST(row_number() OVER (PARTITION BY recovery_time ORDER BY {HASH}, pid)
                <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY recovery_time)) AS BIGINT) AS is_test
            FROM ill_features""",
        "moments": f"""
            SELECT 'all' AS part, {', '.join(moments)} FROM halved
            UNION ALL SELECT 'train', {', '.join(moments)} FROM halved WHERE is_test = 0""",
        "slopes": f"SELECT part, m0, m1, m2, my, {', '.join(slopes)} FROM moments",
        "line": "SELECT part, b0, b1, b2, my - b0*m0 - b1*m1 - b2*m2 AS b FROM slopes",
    }


_PREDICT = "b + b0 * sex + b1 * age + b2 * total_family_members"


def _with_recovery_model(run: dict[str, str]) -> dict[str, str]:
    """The same run with people without symptoms dated back by the regression."""
    out: dict[str, str] = {}
    for name, text in run.items():
        if name == "silent_dated":
            out |= _regression_ctes()
            text = f"SELECT pid, last_day - CAST(round_even({_PREDICT}, 0) AS BIGINT) AS first_day, last_day FROM silent_features, line WHERE part = 'all'"
        out[name] = text
    return out


# -------------------------------------------------------------- logistic model

NEWTON_STEPS = 9


def _z_list(features: Sequence[str]) -> str:
    return ", ".join(["CAST(1 AS DOUBLE)", *(f"(coalesce(CAST({x} AS DOUBLE), 0) - m_{x}) / s_{x}" for x in features)])


def _newton_ctes(source: str, features: Sequence[str]) -> dict[str, str]:
    """Ridge logistic regression with a penalty of 1: every Newton step solves its system by elimination."""
    n = len(features) + 1
    stats = ", ".join(f"avg(coalesce({x}, 0)) AS m_{x}, coalesce(nullif(stddev_pop(coalesce({x}, 0)), 0), 1) AS s_{x}" for x in features)
    out = {
        "risk_stats": f"SELECT {stats} FROM {source}",
        "risk_rows": f"""
            SELECT pid, covid, [{_z_list(features)}] AS x,
                   CAST(row_number() OVER (PARTITION BY covid ORDER BY {HASH}, pid)
                        <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY covid)) AS BIGINT) AS is_test
            FROM {source}, risk_stats""",
        "beta_0": f"SELECT [{', '.join(['CAST(0 AS DOUBLE)'] * n)}] AS b",
    }
    for k in range(NEWTON_STEPS):
        rows = []
        for i in range(1, n + 1):
            curve = [f"sum(p * (1 - p) * x[{i}] * x[{j}])" + (" + 1" if i == j > 1 else "") for j in range(1, n + 1)]
            slope = f"sum((p - covid) * x[{i}])" + (f" + any_value(b[{i}])" if i > 1 else "")
            rows.append(f"[{', '.join([*curve, slope])}]")
        out[f"slope_{k}"] = f"SELECT x, covid, b, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM risk_rows, beta_{k} WHERE is_test = 0"
        system = f"SELECT [{', '.join(rows)}] AS m FROM slope_{k}"
        for c in range(1, n + 1):
            row = f"CASE WHEN i = {c} THEN m[{c}][j] / m[{c}][{c}] ELSE m[i][j] - m[i][{c}] / m[{c}][{c}] * m[{c}][j] END"
            system = f"SELECT [[{row} FOR j IN range(1, {n + 2})] FOR i IN range(1, {n + 1})] AS m FROM ({system})"
        out[f"solved_{k}"] = system
        out[f"beta_{k + 1}"] = f"SELECT [{', '.join(f'b[{i}] - m[{i}][{n + 1}]' for i in range(1, n + 1))}] AS b FROM solved_{k}, beta_{k}"
    return out | {"beta": f"SELECT b FROM beta_{NEWTON_STEPS}",
                  "risk_scores": "SELECT pid, covid, is_test, 1 / (1 + exp(-list_dot_product(x, b))) AS score FROM risk_rows, beta"}


# ------------------------------------------------------------------- federated


def _client_model_ctes() -> dict[str, str]:
    z = ", ".join(
        f"(c.{x} - avg(c.{x}) OVER g) / coalesce(nullif(stddev_pop(c.{x}) OVER g, 0), 1) AS z_{x}"
        for x in FLAT_FEATURES
    )
    zs = [f"z_{x}" for x in FLAT_FEATURES] + ["1.0"]
    size = "count(*) OVER (PARTITION BY client_id, covid)"

    def gradient(error: str) -> str:
        return " UNION ALL ".join(
            f"""SELECT client_id, CAST({j} AS BIGINT) AS idx, sum(row_weight * ({error}) * {x}) AS gradient,
                       count(*) AS n, max(batches) AS batches FROM weighted GROUP BY client_id"""
            for j, x in enumerate(zs)
        )

    return {
        "scaled": f"""
            SELECT c.client_id, c.pid, c.covid, {z} FROM flat c WINDOW g AS (PARTITION BY c.client_id)""",
        "parted": f"""
            SELECT *, CAST(row_number() OVER (PARTITION BY client_id, covid ORDER BY {HASH}, pid)
                           <= ceil(CAST(0.1 AS DOUBLE) * {size}) AS BIGINT) AS is_test FROM scaled""",
        "numbered": f"""
            SELECT *, (row_number() OVER (PARTITION BY client_id ORDER BY {HASH}, pid) - 1) // 128 AS batch
            FROM parted WHERE is_test = 0""",
        "weighted": """
            SELECT *, 1.0 / count(*) OVER (PARTITION BY client_id, batch) AS row_weight,
                   max(batch) OVER (PARTITION BY client_id) + 1 AS batches FROM numbered""",
        "gradient_textbook": gradient("0.5 - covid"),
        "gradient_parity": gradient("(1 / (1 + exp(CAST(-0.5 AS DOUBLE))) - covid) * 0.25"),
        "clipped_textbook": """
            SELECT *, gradient * least(1, 10 / sqrt(sum(gradient * gradient) OVER (PARTITION BY client_id)))
                   AS step FROM gradient_textbook""",
        "epoch_textbook": "SELECT client_id, idx, -0.001 * step AS value, n FROM clipped_textbook",
        "epoch_parity": "SELECT client_id, idx, -0.001 * gradient AS value, n FROM gradient_parity",
        "shared": "SELECT idx, sum(n * value) / sum(n) AS value FROM epoch_textbook GROUP BY idx",
        "logits": "SELECT client_id, pid, covid, is_test, "
        + " + ".join(f"{x} * (SELECT value FROM shared WHERE idx = {j})" for j, x in enumerate(zs))
        + " AS z FROM parted",
        "forecast": "SELECT *, 1 / (1 + exp(-z)) AS score FROM logits",
    }


def _noise(step: int) -> str:
    """Noise of a step for a row with client_id, idx and size (of the last batch)."""
    u, v = (f"((CAST('0x' || md5(concat_ws(':', {SEED}, {step}, client_id, idx, '{part}'))[1:13] AS BIGINT) + 1) / pow(2.0, 52))"
            for part in ("radius", "angle"))
    return f"sqrt(2 * ln(1.25 * size)) / 3 * sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


def _training_ctes(rounds: int, epochs: int, noise: bool = False) -> dict[str, str]:
    """Federated training, step by step; `final` has the shared weights."""
    width = len(FLAT_FEATURES)
    zs = [f"z_{x}" for x in FLAT_FEATURES] + ["1.0"]
    z = " + ".join(f"{x} * w{j}" for j, x in enumerate(zs))
    wide = ", ".join(f"max(value) FILTER (idx = {j}) AS w{j}" for j in range(width + 1))
    out = {"clients": "SELECT DISTINCT client_id FROM weighted",
           "last_batches": "SELECT client_id, count(*) AS size FROM weighted WHERE batch = batches - 1 GROUP BY client_id",
           "base_0": f"SELECT client_id, CAST(idx AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS value FROM clients, (SELECT unnest(range({width + 1})) AS idx)"}
    for r in range(rounds):
        before = f"base_{r}"
        for e in range(epochs):
            k = f"{r}_{e}"
            out[f"wide_{k}"] = f"SELECT client_id, {wide} FROM {before} GROUP BY client_id"
            out[f"pull_{k}"] = f"""
                SELECT t.*, row_weight * (1 / (1 + exp(-({z}))) - covid) AS pull
                FROM weighted t JOIN wide_{k} USING (client_id)"""
            out[f"slope_{k}"] = " UNION ALL ".join(
                f"SELECT client_id, CAST({j} AS BIGINT) AS idx, sum(pull * {x}) AS g, count(*) AS n, max(batches) AS batches FROM pull_{k} GROUP BY client_id"
                for j, x in enumerate(zs))
            out[f"near_{k}"] = f"""
                SELECT s.client_id, s.idx, s.n, c.value, g + 0.01 * batches * (c.value - b.value) AS g
                FROM slope_{k} s JOIN {before} c USING (client_id, idx) JOIN base_{r} b USING (client_id, idx)"""
            shift = _noise(r * epochs + e) if noise else "0"
            out[f"step_{k}"] = f"""
                SELECT client_id, idx, n, value - 0.001 * g * least(1, 10 / sqrt(sum(g * g) OVER (PARTITION BY client_id))) + {shift} AS value
                FROM near_{k} JOIN last_batches USING (client_id)"""
            before = f"step_{k}"
        out[f"mean_{r}"] = f"SELECT idx, sum(n * value) / sum(n) AS value FROM {before} GROUP BY idx"
        out[f"base_{r + 1}"] = f"SELECT client_id, idx, value FROM clients, mean_{r}"
    out["final"] = f"SELECT {wide} FROM mean_{rounds - 1}"
    return out | {"trained": f"SELECT client_id, pid, covid, 1 / (1 + exp(-({z}))) AS score FROM parted, final WHERE is_test = 1"}


def _average_precision(source: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
        SELECT {key}round(coalesce(sum(hits / total * above / seen), 0), 6) AS average_precision
        FROM (SELECT {key}hits, sum(hits) OVER ({part}ORDER BY score DESC) AS above,
                     CAST(sum(rows) OVER ({part}ORDER BY score DESC) AS DOUBLE) AS seen,
                     CAST(nullif(sum(hits) OVER ({part.strip()}), 0) AS DOUBLE) AS total
              FROM (SELECT {key}score, sum(covid) AS hits, count(*) AS rows FROM {source}
                    GROUP BY {key}score)) {by}"""


def feature_columns_of(w: int) -> list[str]:
    return master.feature_columns(RunParams(window=w))


def build() -> dict[str, str]:
    run = run_ctes()
    test = run_ctes(end=56, fixed=55)
    more = run_ctes(extra=True)
    out: dict[str, str] = {}

    def add(name: str, ctes: dict[str, str], select: str) -> None:
        out[name] = statement(ctes, select)

    bounds = "pid, window_end, max_end, min_end"

    edge_columns = "pid1, pid2, lid, start_time, duration, activity1, activity2"
    add("a1_csv_scan", run, f"SELECT {edge_columns} FROM edges")
    add("a6_distinct_contacts", run, "SELECT DISTINCT pid1, pid2, lid FROM edges")
    client = flat_ctes(client=True)
    flat_columns = "pid, total_pat, infect_pat, loc_infect_pat, covid, age, sex, family_infect"
    for name in ("a7_prepared_feature_cache", "k1_client_features"):
        add(name, client, f"SELECT client_id, {flat_columns} FROM flat")
    add("a8_predictions_aligned", test, """
        SELECT p.pid, round(coalesce(s.score, 0.5), 6) AS score
        FROM person p LEFT JOIN scored_test s ON s.pid = p.pid""")
    add("a9_predictions_in_feature_order", test, "SELECT pid, round(score, 6) AS score FROM scored_test")

    add("b1_recovered_timeline", run, "SELECT pid, last_day, first_day FROM recovered")
    add("b2_asymptomatic_timeline", run, "SELECT pid, last_day FROM silent")
    regression = {**run, **_regression_ctes()}
    feature_columns = "pid, sex, age, person_number, total_family_members"
    add("b3a_recovery_training_features", regression,
        f"SELECT {feature_columns}, recovery_time FROM ill_features")
    add("b3b_recovery_scoring_features", regression,
        f"SELECT {feature_columns}, last_day FROM silent_features")
    add("b4_backdated_by_model", regression, f"""
        SELECT pid, last_day - CAST(round_even({_PREDICT}, 0) AS BIGINT) AS first_day, last_day
        FROM silent_features, line WHERE part = 'all'""")
    rare = {
        **regression,
        "person": BASE["person"] + """
            UNION ALL SELECT -max(c_custkey), -max(c_custkey), 1, 30, 1, 0 FROM customer""",
        "states": BASE["states"].replace("FROM person)", "FROM person WHERE pid >= 0)") + """
            UNION ALL SELECT 0, d, p.pid, CASE WHEN d >= 40 THEN 'R' ELSE 'I' END
            FROM (SELECT min(pid) AS pid FROM person) p, (SELECT unnest(range(63)) AS d)""",
    }
    add("b4_backdated_with_rare_value", rare, f"""
        SELECT pid, last_day - CAST(round_even({_PREDICT}, 0) AS BIGINT) AS first_day, last_day
        FROM silent_features, line WHERE part = 'all'""")
    add("b4f_backdated_by_constant", run, "SELECT pid, first_day, last_day FROM silent_dated")
    add("b5_merged_cohort", run, "SELECT pid, first_day, last_day, sym FROM merged")
    add("b6_cohort_with_predicted", more, "SELECT pid, first_day, last_day, sym FROM merged")
    add("b7_infection_intervals", run, "SELECT pid, first_day, last_day FROM spans")
    add("b8_susceptible", run, "SELECT pid, last_day, first_day FROM healthy")
    add("b9_susceptible_inference", run, "SELECT pid, last_day, first_day FROM healthy_now")

    add("c1_contact_table", run, "SELECT * FROM contacts")
    for name, cte in (
        ("c2a_contact_exposure_infected_side1", "contact_ill1"),
        ("c2b_contact_exposure_infected_side2", "contact_ill2"),
        ("c2_contact_exposure_infected", "contact_ill"),
        ("c3a_contact_exposure_uninfected_side1", "contact_well1"),
        ("c3b_contact_exposure_uninfected_side2", "contact_well2"),
        ("c3_contact_exposure_uninfected", "contact_well"),
        ("c4_contact_exposure_inference", "contact_now"),
        ("c5_contact_exposure_all", "contact_all"),
    ):
        add(name, run, f"SELECT {bounds}, total_interactions FROM {cte}")
    add("c6_contact_lags", run, "SELECT * FROM contact_lags_all")
    add("c6_contact_lags_inference", run, "SELECT * FROM contact_lags_now")

    stay = "pid, lid, start_time, duration, first_day, last_day"
    add("d1a_visits_infected", run, f"SELECT {stay} FROM stay_ill")
    add("d1b_visits_susceptible", run, f"SELECT {stay} FROM stay_well")
    add("d1c_visits_susceptible_inference", run, f"SELECT {stay} FROM stay_now")
    for name, cte in (
        ("d2_place_exposure_infected", "place_ill"),
        ("d3_place_exposure_uninfected", "place_well"),
        ("d4_place_exposure_inference", "place_now"),
        ("d6_place_exposure_all", "place_all"),
    ):
        add(name, run, f"SELECT {bounds}, total_interaction, sum_infected_duration FROM {cte}")
    add("d5_place_totals", run, """
        SELECT v.pid, CAST(sum(t.people) AS BIGINT) AS total_loc, round(sum(t.hours), 6) AS total_interaction_loc
        FROM visits v JOIN (SELECT lid, count(pid) AS people, sum(CAST(duration AS DOUBLE) / 60) AS hours
                            FROM visits GROUP BY lid) t ON t.lid = v.lid
        GROUP BY v.pid""")
    add("d7_place_lags", run, "SELECT * FROM place_lags_all")
    add("d7_place_lags_inference", run, "SELECT * FROM place_lags_now")

    add("e0_infected_people", run,
        "SELECT pid, hid, person_number, age, sex, first_day, last_day FROM home_ill")
    for name, cte in (
        ("e1_household_exposure_infected", "family_ill"),
        ("e2_household_exposure_uninfected", "family_well"),
        ("e3_household_exposure_inference", "family_now"),
        ("e4_household_exposure_all", "family_all"),
    ):
        add(name, run, f"SELECT {bounds}, family_infected FROM {cte}")
    add("e5_household_lags", run, "SELECT * FROM family_lags_all")
    add("e5_household_lags_inference", run, "SELECT * FROM family_lags_now")
    add("f1_lag_pivot", run_ctes(w=5), "SELECT * FROM contact_lags_ill")

    add("g1_training_labels", run, "SELECT pid, covid FROM train_labels")
    add("g2_positives_on_day", test, "SELECT pid, covid FROM cases")
    add("g3_testing_labels", test, "SELECT pid, covid FROM test_labels")
    add("g4_inference_set", test, "SELECT pid, covid FROM ahead_labels")
    add("g5_person_features", run, "SELECT * FROM features_all")
    add("g5_person_features_inference", run, "SELECT * FROM features_now")
    add("g6_master_training", run, "SELECT * FROM master_train")
    add("g6_master_testing", test, "SELECT * FROM master_test")
    add("g6_master_inference", test, "SELECT * FROM master_ahead")
    add("g7_master_by_mode", test, """
        SELECT *, 'testing' AS frame FROM master_test
        UNION ALL SELECT *, 'inference' FROM master_ahead""")
    add("g8_study_with_predicted", more, "SELECT * FROM master_train")

    flat = flat_ctes()
    add("h1_affected_cohort", flat, "SELECT pid, day FROM affected")
    add("h2_contact_days", flat, "SELECT pid1, pid2, lid, day_p1, day_p2 FROM meeting_days")
    add("h3_transmission_flags", flat,
        "SELECT pid1, pid2, lid, day_p1, day_p2, infect_p2, infect_p1 FROM flags_onset")
    add("h4_contact_counts", flat, "SELECT pid, total_pat, infect_pat FROM counts_onset")
    add("h5_place_infections", flat, "SELECT lid, loc_infect_pat FROM places_onset")
    add("h6_person_place_infections", flat, "SELECT pid, loc_infect_pat FROM person_places_onset")
    features = "pid, total_pat, infect_pat, loc_infect_pat"
    add("h7_infected_features", flat, f"SELECT {features} FROM features_onset")
    add("h8_recent_infection_flag", flat, "SELECT pid, infect FROM recent")
    add("h9_uninfected_features", flat, f"SELECT {features} FROM features_recent")
    add("h10_flat_frame_training", flat, f"SELECT {flat_columns} FROM flat")
    add("h10_flat_frame_testing", flat_ctes(end=50, training=False), f"SELECT {flat_columns} FROM flat")
    add("h11_true_labels", flat, """
        SELECT pid, count(*) FILTER (state = 'I') AS state_int,
               CAST(count(*) FILTER (state = 'I') >= 1 AS BIGINT) AS true_label
        FROM states WHERE day >= 50 GROUP BY pid""")
    add("h12_status_on_day", flat, """
        SELECT p.pid, p.age, p.sex, CAST(coalesce(s.state = 'I', false) AS BIGINT) AS covid
        FROM person p LEFT JOIN states s ON s.pid = p.pid AND s.day = 54""")

    z = ", ".join(
        f"round(({x} - avg({x}) OVER ()) / coalesce(nullif(stddev_pop({x}) OVER (), 0), 1), 6) AS z_{x}"
        for x in FLAT_FEATURES
    )
    add("i1_standardised_features", flat, f"SELECT pid, {z} FROM flat")
    add("i2_stratified_split", run, f"""
        SELECT pid, covid, CAST(row_number() OVER (PARTITION BY covid ORDER BY {HASH}, pid)
               <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY covid)) AS BIGINT) AS is_test
        FROM train_labels""")
    names = ("sex", "age", "total_family_members")
    slope_rows = " UNION ALL ".join(
        f"SELECT '{x}' AS name, b{i} * (SELECT stddev_pop({x}) FROM halved) AS value FROM line WHERE part = 'all'"
        for i, x in enumerate(names)
    )
    add("i3_recovery_regression", regression, f"""
        SELECT name, round(value, 6) AS value FROM (
            SELECT 'intercept' AS name, my AS value FROM slopes WHERE part = 'all'
            UNION ALL {slope_rows}
            UNION ALL SELECT CASE is_test WHEN 1 THEN 'mse_test' ELSE 'mse_train' END,
                             avg(pow(recovery_time - ({_PREDICT}), 2))
            FROM halved, line WHERE part = 'train' GROUP BY is_test)""")
    risk = {**run, **_newton_ctes("master_train", feature_columns_of(W)), "rounded": "SELECT is_test, covid, round(score, 9) AS score FROM risk_scores"}
    risk["ranked"] = _average_precision("rounded", "is_test")
    values = " UNION ALL ".join(f"SELECT '{x}' AS name, round(b[{i}], 6) AS value FROM beta"
                                for i, x in enumerate(["intercept", *feature_columns_of(W)], 1))
    add("i4_risk_model_quality", risk, f"""
        SELECT CASE is_test WHEN 1 THEN 'auprc_test' ELSE 'auprc_train' END AS name, average_precision AS value FROM ranked
        UNION ALL {values}""")
    learnt = _suffixed({**_with_recovery_model(run), **_newton_ctes("master_train", feature_columns_of(W))}, "_fit")
    add("i6_trained_risk_model", {**learnt, **run}, f"""
        SELECT pid, CAST(score >= 0.5 AS BIGINT) AS covid_predicted, round(score, 6) AS score, covid AS covid_ground_truth
        FROM (SELECT pid, covid, 1 / (1 + exp(-list_dot_product([{_z_list(feature_columns_of(W))}], b))) AS score
              FROM master_train, risk_stats_fit, beta_fit)""")
    fitted = _suffixed({**_with_recovery_model(run_ctes(w=1)), **_newton_ctes("master_train", feature_columns_of(1))}, "_fit")
    asked = {**fitted, **_with_recovery_model(run_ctes(end=56, fixed=55, w=1))}
    add("i7_fit_and_predict", asked, f"""
        SELECT p.pid, round(coalesce(s.score, 0.5), 6) AS score
        FROM person p LEFT JOIN (SELECT pid, 1 / (1 + exp(-list_dot_product([{_z_list(feature_columns_of(1))}], b))) AS score
                                 FROM master_test, risk_stats_fit, beta_fit) s ON s.pid = p.pid""")
    add("i5_scored_people", test, """
        SELECT pid, CAST(score >= 0.5 AS BIGINT) AS covid_predicted, round(score, 6) AS score,
               covid AS covid_ground_truth FROM scored_test""")
    add("a10_saved_risk_model", run, "SELECT pid, CAST(0 AS DOUBLE) AS change FROM master_train")
    quality = {**test, "answers": "SELECT score, covid FROM scored_test"}
    quality["ranked"] = _average_precision("answers")
    add("i8_day_quality", quality, """
        SELECT average_precision,
               round(count(*) FILTER (score >= 0.5 AND covid = 1) / count(*) FILTER (score >= 0.5), 6) AS precision,
               round(count(*) FILTER (score >= 0.5 AND covid = 1) / count(*) FILTER (covid = 1), 6) AS recall
        FROM answers, ranked GROUP BY average_precision""")
    second = run_ctes(end=56, fixed=55, extra=True)
    second["picked"] = "SELECT pid, CAST(55 AS BIGINT) AS first_day FROM scored_ahead_first WHERE score >= 0.5"
    add("i8_daily_loop", {**_suffixed(run_ctes(end=55, fixed=55), "_first"), **second}, """
        SELECT pid, first_day FROM picked
        UNION ALL SELECT pid, CAST(56 AS BIGINT) FROM scored_ahead WHERE score >= 0.5""")
    add("i8_predicted_patients", test,
        "SELECT pid, CAST(56 AS BIGINT) AS first_day FROM scored_ahead WHERE score >= 0.5")

    add("j1_average_precision", flat, _average_precision("rated"))
    add("j1_average_precision_by_client", client, _average_precision("rated", "client_id"))
    add("j2_precision_recall", flat, """
        SELECT round(count(*) FILTER (score >= 0.5 AND covid = 1) / count(*) FILTER (score >= 0.5), 6) AS precision,
               round(count(*) FILTER (score >= 0.5 AND covid = 1) / count(*) FILTER (covid = 1), 6) AS recall
        FROM rated""")
    add("j3_log_loss", flat, """
        SELECT round(-avg(CASE covid WHEN 1 THEN ln(score) ELSE ln(1 - score) END), 6) AS log_loss
        FROM (SELECT covid, greatest(least(score, 1 - 1e-15), 1e-15) AS score FROM rated)""")
    add("j4_mean_squared_error", flat, "SELECT round(avg(pow(covid - score, 2)), 6) AS mse FROM rated")
    add("j5_accuracy", flat, """
        SELECT round(100 * avg(CAST((score >= 0.5) = (covid = 1) AS INTEGER)), 6) AS accuracy FROM rated""")
    add("j5_accuracy_single_column_argmax", flat,
        "SELECT round(100 * avg(CAST(covid = 0 AS INTEGER)), 6) AS accuracy FROM rated")
    add("j6_bce_with_logits", flat, """
        SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * covid), 6) AS bce_loss
        FROM (SELECT covid, ln(p / (1 - p)) AS z
              FROM (SELECT covid, greatest(least(score, 1 - 1e-15), 1e-15) AS p FROM rated))""")
    add("j6_bce_second_sigmoid", flat,
        "SELECT round(avg(ln(1 + exp(-score)) + score - score * covid), 6) AS bce_loss FROM rated")
    add("j7_weighted_average", client, """
        SELECT round(sum(n * accuracy) / sum(n), 6) AS accuracy
        FROM (SELECT client_id, count(*) AS n,
                     100 * avg(CAST((score >= 0.5) = (covid = 1) AS INTEGER)) AS accuracy
              FROM rated GROUP BY client_id)""")

    fed = {**client, **_client_model_ctes()}
    rounded = ", ".join(f"round(z_{x}, 6) AS z_{x}" for x in FLAT_FEATURES)
    add("k2_client_standardised_split", fed, f"SELECT client_id, pid, covid, {rounded}, is_test FROM parted")
    fed_test = {**flat_ctes(end=50, training=False, client=True), **_client_model_ctes()}
    add("k2_test_rows_own_scaler", fed_test, f"SELECT client_id, pid, {rounded} FROM scaled")
    add("k3_zero_params", fed, f"""
        SELECT client_id, CAST(idx AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS value, n
        FROM (SELECT client_id, count(*) AS n FROM person GROUP BY client_id),
             (SELECT unnest(range({len(FLAT_FEATURES) + 1})) AS idx)""")
    for mode in ("textbook", "parity"):
        add(f"k4_local_epoch_{mode}", fed,
            f"SELECT client_id, idx, round(value, 6) AS value, n FROM epoch_{mode}")
    add("k5_proximal_gradient", fed, """
        SELECT client_id, idx, round(gradient + 0.01 * batches * (0.1 * (idx + 1)), 6) AS gradient,
               round(0.005 * sum(pow(0.1 * (idx + 1), 2)) OVER (PARTITION BY client_id), 6) AS proximal_loss
        FROM gradient_textbook""")
    add("k6_clipped_gradient", fed, f"""
        SELECT client_id, idx, round(gradient * least(1, {CLIP_NORM} / sqrt(sum(gradient * gradient)
               OVER (PARTITION BY client_id))), 6) AS gradient FROM gradient_textbook""")
    add("k8_federated_average", fed, "SELECT idx, round(value, 6) AS value FROM shared")
    held = {**fed, "held": "SELECT client_id, covid, round(score, 9) AS score FROM forecast WHERE is_test = 1"}
    held["per_client"] = """
        SELECT client_id, count(*) AS n,
               avg(-(covid * ln(score) + (1 - covid) * ln(1 - score))) AS bce_loss,
               100 * avg(CAST((score >= 0.5) = (covid = 1) AS INTEGER)) AS accuracy
        FROM held GROUP BY client_id"""
    held["ranked"] = _average_precision("held", "client_id")
    add("k9_federated_evaluation", held, """
        SELECT p.client_id, round(bce_loss, 6) AS bce_loss, n, average_precision, round(accuracy, 6) AS accuracy,
               round((SELECT sum(n * bce_loss) / sum(n) FROM per_client), 6) AS overall_bce_loss,
               round((SELECT sum(n * accuracy) / sum(n) FROM per_client), 6) AS overall_accuracy
        FROM per_client p JOIN ranked r ON r.client_id = p.client_id""")
    for name, training in (("k9_federated_training", _training_ctes(2, 2)), ("k9_default_training", _training_ctes(1, 5, noise=True))):
        taught = {**fed, **training}
        taught["ranked"] = _average_precision("trained", "client_id")
        add(name, taught, """
            SELECT t.client_id, count(*) AS n, max(average_precision) AS average_precision,
                   round(avg(-(covid * ln(score) + (1 - covid) * ln(1 - score))), 6) AS bce_loss,
                   round(100 * avg(CAST((score >= 0.5) = (covid = 1) AS INTEGER)), 6) AS accuracy
            FROM trained t JOIN ranked r ON r.client_id = t.client_id GROUP BY t.client_id""")
    noisy = {**fed, **_training_ctes(1, 5, noise=True)}
    add("k7_default_weights", noisy, "SELECT CAST(0 AS BIGINT) AS round, idx, round(value, 6) AS value FROM mean_0")
    add("k7_gaussian_mechanism", noisy, f"""
        SELECT client_id, idx, n, round(value + {_noise(0)}, 6) AS value FROM epoch_textbook JOIN last_batches USING (client_id)""")
    add("k7_privacy_spent", noisy, """
        SELECT round, client_id, steps, CAST(3 * steps AS DOUBLE) AS epsilon, round(least(1, steps / size), 6) AS delta,
               round(rho + 2 * sqrt(rho * ln(size)), 6) AS tight_epsilon
        FROM (SELECT *, steps * 9 / (4 * ln(1.25 * size)) AS rho
              FROM (SELECT client_id, CAST(size AS DOUBLE) AS size, round, 5 * (round + 1) AS steps
                    FROM last_batches, (SELECT unnest(range(3)) AS round)))""")
    later = _suffixed(flat_ctes(end=50, training=False, client=True), "_later")
    ahead = {**fed, **later}
    stats = ", ".join(f"avg({x}) AS m_{x}, coalesce(nullif(stddev_pop({x}), 0), 1) AS s_{x}" for x in FLAT_FEATURES)
    for name, source in (("trained", "flat"), ("own", "flat_later")):
        ahead[f"stats_{name}"] = f"SELECT client_id, {stats} FROM {source} GROUP BY client_id"
        z = " + ".join(f"(t.{x} - m_{x}) / s_{x} * (SELECT value FROM shared WHERE idx = {j})" for j, x in enumerate(FLAT_FEATURES))
        ahead[f"predicted_{name}"] = f"""
            SELECT t.client_id, t.pid, 1 / (1 + exp(-({z} + (SELECT value FROM shared WHERE idx = {len(FLAT_FEATURES)})))) AS score
            FROM flat_later t JOIN stats_{name} USING (client_id)"""
    columns = "client_id, pid, round(score, 6) AS score"
    add("k10_client_predictions", ahead, f"SELECT {columns} FROM predicted_trained")
    add("k10_predictions_own_scaling", ahead, f"SELECT {columns} FROM predicted_own")
    judged = {**ahead, "truth": """
        SELECT pid, CAST(count(*) FILTER (state = 'I') >= 1 AS BIGINT) AS ill FROM states
        WHERE day >= 50 GROUP BY pid""", "judged": """
        SELECT f.client_id, coalesce(t.ill, 0) AS covid, round(f.score, 9) AS score
        FROM predicted_trained f LEFT JOIN truth t ON t.pid = f.pid"""}
    add("k10_outcome_precision", judged, _average_precision("judged", "client_id"))
    add("k10_saved_rounds", fed,
        "SELECT CAST(0 AS BIGINT) AS round, idx, round(value, 6) AS value FROM shared")
    add("k11_equal_parts", run, f"SELECT pid, ntile(7) OVER (ORDER BY {HASH}, pid) AS part FROM person")
    return out
