"""What tests share."""

SMALL = "/root/testdata/sf0.001"


def told(frame):
    """Rows as sorted tuples of strings, columns by name."""
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, row)) for row in frame[columns].itertuples(index=False))


def same(spark, duck, query, sql):
    assert told(query(spark, SMALL).toPandas()) == told(duck.sql(sql).df())
