import pytest

from kindred.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", 4, "4g")
    yield session
    session.stop()


RATINGS = [(22, 86, 3, 881250949), (186, 302, 3, 891717742), (22, 377, 1, 878887116), (186, 51, 2, 880606923),
           (166, 346, 1, 886397596), (22, 346, 4, 884182806), (166, 377, 2, 881171488), (253, 465, 5, 891628467),
           (166, 451, 3, 886324817), (6, 86, 3, 883603013)]


@pytest.fixture(scope="session")
def ratings(spark):
    """Ten ratings of five users."""
    from kindred import schemas
    return spark.createDataFrame([(u, i, float(r), t) for u, i, r, t in RATINGS], schemas.RATINGS).cache()


@pytest.fixture(scope="session")
def many(spark):
    """2,000 distinct ratings of 120 users on 80 items, one of which a third of all rows are about."""
    import random
    from kindred import schemas
    rng, seen = random.Random(7), {}
    for u in range(120):
        seen[(u, 0)] = (float(rng.randint(1, 5)), rng.randint(0, 3_000_000))
    while len(seen) < 2000:
        key = (rng.randrange(120), int(80 * rng.random() ** 2))
        seen[key] = (float(rng.randint(1, 5)), rng.randint(0, 3_000_000))
    rows = [(u, i, r, t) for (u, i), (r, t) in seen.items()]
    return spark.createDataFrame(rows, schemas.RATINGS).cache()
