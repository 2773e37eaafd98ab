import random

from weighbridge.operators import replay

STATES = [("d", "s1", True, 2, "state", "s2", "terminal", "End"), ("d", "s2", False, 1, "terminal", "Go", "state", "s1"), ("e", "t1", True, 1, "state", "gone", "terminal", "No")]
QUESTIONS = [("d", "s1", "q1", 0), ("d", "s1", "q2", 1), ("d", "s1", "q3", 2), ("d", "s2", "q4", 0), ("e", "t1", "q1", 0)]
FIELDS = ("status", "action", "consumed", "unconsumed", "failure_state", "failure_question", "problem")


def brute(domain, log):
    """One case, step by step."""
    rounds = [d[0] for d in log]
    log = sorted(log, key=lambda d: d[0])
    wrong = lambda p: (None, None, None, None, None, None, p)
    if len(set(rounds)) < len(rounds):
        return wrong("duplicate round")
    if rounds and max(rounds) - min(rounds) + 1 != len(rounds):
        return wrong("gap in rounds")
    machine = {s[1]: s for s in STATES if s[0] == domain}
    asks = {s: [q[2] for q in QUESTIONS if q[:2] == (domain, s)] for s in machine}
    at = next((s for s in machine if machine[s][2]), None)
    if at is None:
        return ("TREE_FAILURE", None, 0, len(log), None, None, None)
    n = yes = used = 0
    seen = []
    for _, state, question, answer, frozen, failed, of in log:
        if of != domain:
            return wrong("another domain")
        if state != at:
            return wrong("another state")
        if question != asks[at][n]:
            return wrong("another question")
        if not failed and answer is not None and answer != frozen:
            return wrong("another answer")
        used += 1
        if failed or answer is None:
            return ("RUNTIME_FAILURE" if failed else "OUTPUT_FAILURE", None, used, len(log) - used, at, question, None)
        yes += answer == "yes"
        n += 1
        if yes >= machine[at][3] or n == len(asks[at]):
            kind, to = machine[at][4:6] if yes >= machine[at][3] else machine[at][6:8]
            seen.append(at)
            if kind == "terminal":
                return ("COMPLETED", to, used, 0, None, None, None) if used == len(log) else wrong("log goes on after the walk")
            if to in seen or to not in machine:
                return ("TREE_FAILURE", None, used, len(log) - used, at, None, None)
            at, n, yes = to, 0, 0
    return wrong("log ended before the walk")


def test_replay_equals_brute_force(spark):
    r = random.Random(3)
    logs = {}
    for i in range(250):
        domain = r.choice(["d", "d", "d", "e", "none"])
        log, state, k = [], "s1" if domain == "d" else "t1", 0
        for n in range(r.randrange(0, 6)):
            asked = ["q1", "q2", "q3"][k % 3] if state == "s1" else "q4" if state == "s2" else "q1"
            frozen = r.choice(["yes", "no"])
            answer = r.choice([frozen] * 9 + [None, "yes"])
            log.append((n, state if r.random() < 0.97 else "s9", asked if r.random() < 0.97 else "q9", answer, frozen, r.random() < 0.04, domain if r.random() < 0.98 else "x"))
            k += 1
            if state == "s1" and (sum(d[4] == "yes" for d in log) >= 2 or k == 3):
                state = "s2"
        if log and r.random() < 0.15:
            log[-1] = (log[-1][0] + r.choice([-1, 1]), *log[-1][1:])
        r.shuffle(log)
        logs[str(i)] = (domain, log)
    machines = replay.packed(spark.createDataFrame(STATES, "domain string, state string, root boolean, minimum int, yes_kind string, yes_to string, no_kind string, no_to string"), spark.createDataFrame(QUESTIONS, "domain string, state string, question string, at int"))
    cases = spark.createDataFrame([(c, d) for c, (d, _) in logs.items()], "case string, domain string")
    rows = [(c, d[6], *d[:6]) for c, (_, log) in logs.items() for d in log]
    decisions = spark.createDataFrame(rows, "case string, domain string, round int, state string, question string, answer string, frozen string, runtime_failed boolean")
    got = {x.case: tuple(x[f] for f in FIELDS) for x in replay.replay(machines, cases, decisions).collect()}
    want = {c: brute(d, log) for c, (d, log) in logs.items()}
    bad = {c: (logs[c], got[c], want[c]) for c in want if got[c] != want[c]}
    assert not bad, list(bad.items())[:3]
    assert {w[0] for w in want.values()} >= {"COMPLETED", "OUTPUT_FAILURE", "RUNTIME_FAILURE", "TREE_FAILURE"} and len({w[-1] for w in want.values()}) >= 6


def test_a_step_works_out_its_rule_once(spark):
    states = spark.createDataFrame(STATES, "domain string, state string, root boolean, minimum int, yes_kind string, yes_to string, no_kind string, no_to string")
    machines = replay.packed(states, spark.createDataFrame(QUESTIONS, "domain string, state string, question string, at int"))
    decisions = spark.createDataFrame([], "case string, domain string, round int, state string, question string, answer string, frozen string, runtime_failed boolean")
    out = replay.replay(machines, spark.createDataFrame([("1", "d")], "case string, domain string"), decisions)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1  # a case is walked once
    assert plan.count("element_at(") == 2  # by state: its rule, and whether a target is there
