import decimal
import threading

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if v != v else f"{round(float(v), 6) + 0.0:.6f}"
    return str(v)


def rows_of(rows):
    """Rows as sorted tuples of text, numbers to six places."""
    return sorted(tuple(plain(v) for v in r) for r in rows)


def together(*jobs):
    """Run jobs in threads of their own and return what they raise."""
    raised, gate = [], threading.Barrier(len(jobs))

    def run(job):
        gate.wait()
        try:
            job()
        except Exception as e:  # noqa: BLE001
            raised.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return raised
