"""The report's fits, itemsets and customers are made side by side."""
import threading

from tillsight.plans import queries as Q


def test_report_tables_are_made_at_the_same_time(spark, monkeypatch):
    together, made, sizes = threading.Barrier(3, timeout=20), [], {}
    key = "spark.sql.files.maxPartitionBytes"

    def maker(name):
        def make(session, sf):
            with Q.bounded_tasks(session, 10):
                together.wait()  # broken, and so an error, where one waits for another's end
                sizes[name] = session.conf.get(key)
            together.wait()
            sizes[name + " after"] = session.conf.get(key)
            made.append(name)
        return make

    for name in ("validation", "item_itemsets", "customers"):
        monkeypatch.setattr(Q, name, maker(name))
    monkeypatch.setattr(Q, "split_table", lambda session, sf: made.append("split"))
    monkeypatch.setattr(Q, "table", lambda session, sf, name: session.range(10))
    before = spark.conf.get(key)
    Q.make_report_tables(spark, "none")
    assert made[0] == "split" and sorted(made[1:]) == ["customers", "item_itemsets", "validation"]
    assert len(set(sizes.values())) == 1 and spark.conf.get(key) == before
