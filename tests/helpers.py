def rows(df, *columns, key=None):
    """Collected rows as tuples, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(str(x) for x in r))


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def statuses(checks):
    return {r["check_name"]: r["status"] for r in checks.collect()}
