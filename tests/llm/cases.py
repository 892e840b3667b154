"""Small tables that the tests of the text operators share."""
import duckdb

ODD = [None, "", " \n\t", "a", "one two three four", "ü ß 日本 ▁ x", "x" * 3000, "same words here again and again", "same words here again and again"]


def documents(spark, texts=None, **extra):
    """documents with an extra column whose name operators use inside."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), "clash") for i, t in enumerate(ODD if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash string")


def with_null_id(df):
    spark = df.sparkSession
    return df.unionByName(spark.createDataFrame([(None, "no id here at all", None, None, None, None)], df.schema))


def table(sf_dir, name):
    return duckdb.connect().execute(f"select * from '{sf_dir}/{name}.parquet'")


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()
