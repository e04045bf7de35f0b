"""What tests share."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    """Rows in the order of their column names, and sorted; numbers without their kind."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def same(frame, con, sql):
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows_of(names, cursor.fetchall())
