"""A small sequential model of a connection, and random traffic to feed it."""

import datetime as dt
import random

RESETS = ("DISCARD ALL", "RESET ALL", "DEALLOCATE ALL")

# statement text, class
TEXTS = [
    ("SELECT 1", "plain_select"), ("SELECT run_job(1)", "proc_select"),
    ("INSERT INTO t VALUES (1)", "dml"), ("CREATE TABLE x (a int)", "ddl"),
    ("BEGIN", "begin"), ("COMMIT", "commit_rollback"), ("ROLLBACK", "commit_rollback"),
    ("SET a = 1", "utility"), ("VACUUM", "unknown"), ("DISCARD ALL", "utility"),
    ("DEALLOCATE ALL", "unknown"), ("COPY t FROM STDIN", "copy_from"),
    ("SELECT '" + "x" * 80 + "'", "plain_select"),
]
CLASS = dict(TEXTS)


def random_messages(seed, n, conns=5, lives=2, prepared_reset=True):
    rng = random.Random(seed)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    micros = 0
    for pos in range(n):
        micros += rng.choice([0, 0, 1, 5, 1000])
        kind = rng.choices("QPBdcfCZ", weights=[8, 3, 5, 5, 3, 1, 4, 4])[0]
        text = rng.choice(TEXTS)[0]
        if kind == "P" and not prepared_reset and text in RESETS:
            text = "SELECT 1"
        values = [rng.choice([None, b"a", b"bb"]) for _ in range(rng.randint(0, 3))]
        rows.append(dict(
            conn_key=f"c{rng.randrange(conns)}", life=pos * lives // n, pos=pos * 3 + 1,
            ts=t0 + dt.timedelta(microseconds=micros), from_client=kind not in "CZ",
            msg_type=kind, sql=text if kind in "QP" else None,
            stmt_name=rng.choice(["", "s1"]) if kind in "PB" else None,
            param_oids=[rng.randint(1, 99) for _ in range(rng.randint(0, 3))]
            if kind == "P" else None,
            param_formats=[rng.randint(0, 1) for _ in range(rng.randint(0, 3))]
            if kind == "B" else None,
            param_values=values if kind == "B" else None,
            chunk=bytes(rng.randint(0, 9)) if kind == "d" else None,
            tx_status=rng.choice("ITE?") if kind == "Z" else None,
            database="db", db_user="u"))
    return rows


def zip_params(oids, formats, values):
    out = []
    for i in range(max(len(oids), len(values))):
        code = formats[0] if len(formats) == 1 else formats[i] if i < len(formats) else 0
        out.append((oids[i] if i < len(oids) else 0, values[i] if i < len(values) else None, code))
    return out


class Conn:
    def __init__(self):
        self.defs, self.copy, self.tx, self.seq = {}, None, 0, 0
        self.state, self.pending, self.sess = "idle", None, 0


def replay(rows, pooler=False, max_sql=1 << 20, max_copy=256 << 20, extended=True):
    """Events, timings and error count, one message at a time."""
    conns, counter = {}, 0
    events, timings, errors, sessions = [], [], 0, []
    for m in rows:
        c = conns.setdefault((m["conn_key"], m["life"]), Conn())
        kind = m["msg_type"]
        sessions.append((m["pos"], c.sess))

        def dispatch(sql, params=None, chunks=None):
            nonlocal counter
            cls = CLASS[sql]
            if cls == "begin" or (c.tx == 0 and cls in ("dml", "ddl", "copy_from")):
                counter += 1
                c.tx = counter
            c.seq += 1
            events.append((m["pos"], sql, c.seq, c.tx, c.state, cls, params, chunks))
            if cls == "begin":
                c.state = "in_tx"
            if cls == "commit_rollback":
                c.state, c.tx = "idle", 0
            if pooler and sql in RESETS:
                c.defs, c.copy, c.tx, c.pending = {}, None, 0, None
                c.sess += 1

        if kind in "QP" and (kind == "Q" or extended) and len(m["sql"]) > max_sql:
            errors += 1
        elif kind == "P" and extended:
            c.defs[m["stmt_name"]] = (m["sql"], m["param_oids"])
        elif kind == "B":
            if m["stmt_name"] in c.defs:
                sql, oids = c.defs[m["stmt_name"]]
                dispatch(sql, zip_params(oids, m["param_formats"], m["param_values"]))
                c.pending = m["ts"]
            else:
                errors += 1
        elif kind == "Q":
            if CLASS[m["sql"]] == "copy_from":
                c.copy = (m["sql"], [])
            else:
                dispatch(m["sql"])
            c.pending = m["ts"]
        elif kind == "d" and c.copy:
            c.copy[1].append(m["chunk"])
        elif kind == "f":
            c.copy = None
        elif kind == "c" and c.copy:
            sql, chunks = c.copy
            c.copy = None
            if sum(map(len, chunks)) <= max_copy:
                dispatch(sql, None, chunks)
        elif kind in "CZ":
            if kind == "Z" and m["tx_status"] in "ITE":
                c.state = {"I": "idle", "T": "in_tx", "E": "failed"}[m["tx_status"]]
            if c.pending is not None:
                took = round((m["ts"] - c.pending).total_seconds() * 1e6) * 1000
                c.pending = None
                if took > 0:
                    timings.append((m["pos"], c.seq, took))
    return events, timings, errors, sessions
