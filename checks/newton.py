"""Newton fits written out as SQL, to check the batched models.

``fit_sql`` turns rows ``(m, y, w, x1..xk)`` into CTEs: merged patterns, one CTE
per Newton step with the linear system solved by elimination, and at the end
``fit`` (coefficients per model), ``info`` and ``meat``.
"""

from __future__ import annotations


def _tri(p):
    return [(i, j) for i in range(p) for j in range(i, p)]


def solve(name: str, source: str, p: int, rhs: str, out: str, keep: str = "") -> list[str]:
    """CTEs that solve A v = rhs for the symmetric A (columns a{i}_{j}) of ``source``."""
    ctes, prev = [], source
    full = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    first = ", ".join(f"{full(i, j)} AS s{i}_{j}" for i in range(p) for j in range(p))
    r = ", ".join(f"{rhs}{i} AS r{i}" for i in range(p))
    ctes.append(f"{name}_0 AS (SELECT m{keep}, {first}, {r} FROM {prev})")
    for k in range(p - 1):
        cols = []
        for i in range(p):
            for j in range(p):
                cols.append(f"s{i}_{j} - s{i}_{k} / s{k}_{k} * s{k}_{j} AS s{i}_{j}" if i > k else f"s{i}_{j}")
            cols.append(f"r{i} - s{i}_{k} / s{k}_{k} * r{k} AS r{i}" if i > k else f"r{i}")
        ctes.append(f"{name}_{k + 1} AS (SELECT m{keep}, {', '.join(cols)} FROM {name}_{k})")
    prev = f"{name}_{p - 1}"
    for k in reversed(range(p)):
        done = ", ".join(f"{out}{j}" for j in range(k + 1, p))
        rest = "".join(f" - s{k}_{j} * {out}{j}" for j in range(k + 1, p))
        cols = ", ".join(f"s{i}_{j}" for i in range(p) for j in range(p)) + ", " + ", ".join(f"r{i}" for i in range(p))
        ctes.append(f"{name}_b{k} AS (SELECT m{keep}, {cols}{', ' + done if done else ''}, (r{k}{rest}) / s{k}_{k} AS {out}{k} FROM {prev})")
        prev = f"{name}_b{k}"
    ctes.append(f"{name} AS MATERIALIZED (SELECT m{keep}, {', '.join(f'{out}{k}' for k in range(p))} FROM {prev})")
    return ctes


def fit_sql(rows: str, k: int, steps: int = 9, family: str = "poisson", ridge: float = 0.0) -> str:
    """CTE list (without WITH) ending in ``fit``, ``info`` and ``meat``."""
    p = k + 1
    x = ["1"] + [f"x{i}" for i in range(1, p)]
    xs = ", ".join(x[1:])
    full = " AND ".join(f"{c} IS NOT NULL" for c in ["y", "w", *x[1:]])
    ctes = [
        f"pat AS MATERIALIZED (SELECT m, {xs}, count(*) AS n, sum(y) AS ev, sum(w) AS sw, sum(w * y) AS swy, sum(w * w) AS sw2, sum(w * w * y) AS sw2y, "
        f"sum(w * w * y * y) AS sw2yy FROM ({rows}) WHERE {full} GROUP BY ALL)",
    ]
    start = "ln(sum(swy) / sum(sw))" if family == "poisson" else "ln(sum(swy) / (sum(sw) - sum(swy)))"
    ctes.append(f"t0 AS MATERIALIZED (SELECT m, {start} AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(1, p))} FROM pat GROUP BY 1)")
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))

    def sums(step, name, materialized=""):
        mu = f"exp({eta})" if family == "poisson" else f"1 / (1 + exp(-({eta})))"
        var = "mu" if family == "poisson" else "mu * (1 - mu)"
        a = ", ".join(f"sum(sw * {var} * {x[i]} * {x[j]}){f' + {ridge}' if ridge and i == j and i > 0 else ''} AS a{i}_{j}" for i, j in _tri(p))
        g = ", ".join(f"sum((swy - sw * mu) * {c}){f' - {ridge} * min(b{i})' if ridge and i > 0 else ''} AS g{i}" for i, c in enumerate(x))
        return f"{name} AS MATERIALIZED (SELECT m, {a}, {g} FROM (SELECT pat.*, {', '.join(f'b{i}' for i in range(p))}, {mu} AS mu FROM pat JOIN {step} USING (m)) GROUP BY 1)"

    for s in range(steps):
        ctes.append(sums(f"t{s}", f"n{s}"))
        ctes += solve(f"d{s}", f"n{s}", p, "g", "d")
        ctes.append(f"t{s + 1} AS MATERIALIZED (SELECT m, {', '.join(f'b{i} + d{i} AS b{i}' for i in range(p))} FROM t{s} JOIN d{s} USING (m))")
    ctes.append(f"fit AS (SELECT * FROM t{steps})")
    ctes.append(sums(f"t{steps}", "info"))
    mu = f"exp({eta})" if family == "poisson" else f"1 / (1 + exp(-({eta})))"
    q = ", ".join(f"sum((sw2yy - 2 * mu * sw2y + mu * mu * sw2) * {x[i]} * {x[j]}) AS q{i}_{j}" for i, j in _tri(p))
    ctes.append(
        f"meat AS MATERIALIZED (SELECT m, sum(n)::BIGINT AS n, sum(ev) AS events, {q} FROM (SELECT pat.*, {', '.join(f'b{i}' for i in range(p))}, {mu} AS mu "
        f"FROM pat JOIN fit USING (m)) GROUP BY 1)"
    )
    return ", ".join(ctes)


def variance(name: str, p: int, vector: str, source: str = "info", out: str = "var") -> str:
    """CTEs ending in ``name(m, out)`` = v' V v for the vector columns of ``source``
    (which must also hold the a-columns); V is the robust covariance."""
    ctes = solve(f"{name}_s", source, p, vector, "z")
    quad = " + ".join(f"{'' if i == j else '2 * '}z{i} * z{j} * q{i}_{j}" for i, j in _tri(p))
    ctes.append(f"{name} AS (SELECT m, {quad} AS {out} FROM {name}_s JOIN meat USING (m))")
    return ", ".join(ctes)


def se_of(term: int, k: int, name: str = "v") -> str:
    """CTEs ending in ``name(m, var)`` for one coefficient."""
    p = k + 1
    unit = ", ".join(f"{1.0 if i == term else 0.0}::DOUBLE AS u{i}" for i in range(p))
    return f"{name}_u AS (SELECT *, {unit} FROM info), " + variance(name, p, "u", f"{name}_u")
