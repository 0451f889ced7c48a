"""Small made-up site tables with known truth."""

import numpy as np

SITE_COLUMNS = "region string, municipality string, site_id bigint, tests bigint, successes bigint"


def planted_small(spark, seed=7, sites=8, municipalities=3, tests=(5, 300)):
    """2 regions x municipalities x sites; returns the table and the true means."""
    rng = np.random.default_rng(seed)
    rows, means, thetas = [], {}, {}
    i = 0
    for region, a in (("north", 0.45), ("south", 0.70)):
        for j in range(municipalities):
            name = f"{region}-{j}"
            m = rng.beta(a * 20, (1 - a) * 20)
            means[name] = m
            for _ in range(sites):
                theta = rng.beta(m * 10, (1 - m) * 10)
                n = int(rng.integers(*tests))
                rows.append((region, name, i, n, int(rng.binomial(n, theta))))
                thetas[i] = theta
                i += 1
    return spark.createDataFrame(rows, SITE_COLUMNS), means, thetas


def site_rows(spark, rows):
    return spark.createDataFrame(rows, SITE_COLUMNS)
