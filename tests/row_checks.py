"""Comparing Spark rows with those of SQL."""


def same_rows(spark_df, oracle_df):
    """Row for row equality, whatever the order of rows and columns."""
    import numpy as np

    cols = sorted(oracle_df.columns)
    assert sorted(spark_df.columns) == cols

    def shown(v):
        if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) == "<NA>":
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return repr(float(v) + 0.0)
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    a, b = (x[cols].map(shown).sort_values(cols).reset_index(drop=True) for x in (spark_df, oracle_df))
    assert len(a) == len(b)
    bad = (a != b).any(axis=1)
    assert not bad.any(), (a[bad].head(3).to_dict("records"), b[bad].head(3).to_dict("records"))
