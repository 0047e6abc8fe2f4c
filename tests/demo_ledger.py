"""A ledger of the demo ledger's shape, made from a seed: bank, broker, card,
retirement and vacation-hours accounts, lots with cost, sales at a price, tags,
amounts left out, prices every week, balance assertions.  ``make`` returns its
text and the values that tests expect of it, summed from the transactions that
the text was written from, without parsing it."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

START, END = dt.date(2015, 1, 1), dt.date(2017, 9, 8)
FUNDS = ["AAF", "BBF", "CCF"]
D2 = Decimal("0.01")


def make(seed=11):
    rng = random.Random(seed)
    money = lambda lo, hi: (Decimal(rng.randrange(lo * 100, hi * 100)) * D2).quantize(D2)
    spend = ["Expenses:Food:Groceries", "Expenses:Food:Restaurant", "Expenses:Home:Rent", "Expenses:Home:Phone", "Expenses:Transport:Tram",
             "Expenses:Taxes:Federal", "Expenses:Financial:Fees"]
    accounts = ["Assets:US:Bank:Checking", "Assets:US:Broker:Cash", *(f"Assets:US:Broker:{f}" for f in FUNDS), "Assets:US:Retirement:Match",
                "Assets:US:Employer:Vacation", "Liabilities:US:Card", "Income:US:Salary", "Income:US:Gains", "Income:US:Match",
                "Income:US:Vacation", "Expenses:Vacation", "Equity:Opening", *spend]
    txns, lots, prices = [], [], {}
    day = lambda n: START + dt.timedelta(days=n)
    for n in range(0, (END - START).days + 1, 7):
        for f in FUNDS:
            prices[f, day(n)] = (Decimal(50) + money(0, 60)).quantize(D2)

    def txn(date, payee, legs, tags=()):
        """legs: account, number, currency, cost (number, date), price; the last number may be written or left out."""
        txns.append((date, payee, legs, tags))

    txn(START, "Opening", [("Assets:US:Bank:Checking", Decimal("6041.12"), "USD", None, None), ("Equity:Opening", Decimal("-6041.12"), "USD", None, None)])
    for n in range(3, (END - START).days + 1):
        d = day(n)
        if n % 14 == 0:
            pay = money(2000, 2500)
            txn(d, "Employer", [("Assets:US:Bank:Checking", pay, "USD", None, None), ("Income:US:Salary", -pay, "USD", None, None),
                                ("Assets:US:Retirement:Match", Decimal(300), "IRAUSD", None, None), ("Income:US:Match", Decimal(-300), "IRAUSD", None, None),
                                ("Assets:US:Employer:Vacation", Decimal(5), "VACHR", None, None), ("Income:US:Vacation", Decimal(-5), "VACHR", None, None)])
        if n % 90 == 0:
            txn(d, "Beach", [("Expenses:Vacation", Decimal(40), "VACHR", None, None), ("Assets:US:Employer:Vacation", Decimal(-40), "VACHR", None, None)], ("trip",))
        if rng.random() < 0.9:
            a, x, paid = rng.choice(spend), money(3, 90), rng.choice(["Liabilities:US:Card", "Assets:US:Bank:Checking"])
            txn(d, f"Shop {n % 13}", [(a, x, "USD", None, None), (paid, -x, "USD", None, None)], ("food", "day-%d" % (n % 7)) if "Food" in a else ())
        if n % 9 == 0:
            f, k, c = rng.choice(FUNDS), Decimal(rng.randrange(1, 30)), money(40, 120)
            txn(d, "Broker buys", [(f"Assets:US:Broker:{f}", k, f, (c, d), None), ("Assets:US:Bank:Checking", -(k * c), "USD", None, None)])
            lots.append((f, k, c, d))
        if n % 200 == 0 and lots:
            f, k, c, when = lots.pop(0)
            p = money(50, 130)
            txn(d, "Broker sells", [(f"Assets:US:Broker:{f}", -k, f, (c, when), p), ("Assets:US:Broker:Cash", k * p, "USD", None, None),
                                    ("Income:US:Gains", k * c - k * p, "USD", None, None)])

    legs = [(d, a, x, c, cost, price) for d, _, ls, _ in txns for a, x, c, cost, price in ls]
    lines = ['option "title" "made for tests"', 'option "operating_currency" "USD"', ""]
    for a in accounts:
        lines.append(f"{START} open {a}" + (" USD" if a in ("Assets:US:Bank:Checking", "Liabilities:US:Card") else ""))
    lines += [f'{START} commodity {c}\n  name: "{c}"' for c in ["USD", "IRAUSD", "VACHR", *FUNDS]]
    left_out = 0
    for k, (d, payee, ls, tags) in enumerate(txns):
        lines += ["", f'{d} * "{payee}" "n{k}"' + "".join(f" #{t}" for t in tags)]
        for i, (a, x, c, cost, price) in enumerate(ls):
            if len(ls) == 2 and i == 1 and k % 5 == 0:
                lines.append(f"  {a}")             # the other leg gives its amount
                left_out += 1
                continue
            text = f"  {a}  {x:,} {c}" if k % 3 == 0 else f"  {a}   {x} {c}"
            text += f" {{{cost[0]} USD, {cost[1]}}}" if cost and cost[1] != d else f" {{{cost[0]} USD}}" if cost else ""
            lines.append(text + (f" @ {price} USD" if price else "") + ("  ; a note" if k % 7 == 0 else ""))
    checked = 0
    for n in range(12, (END - START).days, 12):
        a = ["Assets:US:Bank:Checking", "Liabilities:US:Card", "Assets:US"][checked % 3]
        total = sum((x for d, b, x, c, _, _ in legs if c == "USD" and d < day(n) and (b == a or b.startswith(a + ":"))), Decimal(0))
        lines.append(f"{day(n)} balance {a}  {total} USD")
        checked += 1
    lines += [f"{d} price {f}  {p} USD" for (f, d), p in prices.items()]
    lines += [f'{day(30 * k)} event "location" "place {k}"' for k in range(9)]

    def price_at(c, d):
        if c == "USD":
            return Decimal(1)
        known = [x for (f, x) in prices if f == c and x <= d]
        return prices[c, max(known)] if known else None

    def units(d, types=("Assets", "Liabilities")):
        out = defaultdict(Decimal)
        for x, a, n, c, _, _ in legs:
            if x <= d and a.split(":")[0] in types:
                out[c] += n
        return dict(out)

    spent = defaultdict(Decimal)
    for d, a, x, c, _, _ in legs:
        if a.startswith("Expenses:") and c == "USD":
            spent[d.year, a] += x
    held = defaultdict(Decimal)
    for d, a, x, c, cost, _ in legs:
        if a.startswith("Assets"):
            held[a, c, cost] += x
    days = [START, dt.date(2015, 12, 31), dt.date(2016, 6, 30), END]
    first, last = min(d for _, d in prices), max(d for _, d in prices)
    gold = {
        "transactions": len(txns), "postings": len(legs), "lots": sum(1 for x in legs if x[4]), "priced": sum(1 for x in legs if x[5]),
        "accounts": len({x[1] for x in legs}), "prices": len(prices), "directives": (len(accounts), checked, 6, 9, 0),
        "networth": [(d, sum((n * price_at(c, d) for c, n in units(d).items() if price_at(c, d)), Decimal(0))) for d in days],
        "units_day": END, "units": units(END),
        "spent": {y: sum((x for (z, _), x in spent.items() if z == y), Decimal(0)) for y in (2015, 2016, 2017)},
        "food": tuple(sum((x for (z, a), x in spent.items() if z == y and a.startswith("Expenses:Food:")), Decimal(0)) for y in (2015, 2016)),
        "taxes": sum((x for (z, a), x in spent.items() if z == 2015 and a.startswith("Expenses:Taxes")), Decimal(0)),
        "gaps": (len(FUNDS), first, last, len(FUNDS) * ((last - first).days + 1) - len(prices)),
        "holding_lots": (sum(1 for k in held if k[2]), sum(1 for k, n in held.items() if k[2] and n), sum(1 for k in held if not k[2])),
        "left_out": left_out,
    }
    return "\n".join(lines) + "\n", gold
