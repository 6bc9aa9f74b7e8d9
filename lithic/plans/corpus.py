"""Source text written by Spark from the orders table: one small file per order.

The priority of an order picks the language. Every line is known in advance, so the oracle can state
the expected facts straight from the order columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.plans.warehouse import Warehouse

# {k} order key, {c} customer key, {n} a number from the price, {h} a hex string, {y} the year.
TEMPLATES = {
    "1-URGENT": ("python", "svc/y{y}/order_{k}.py", """# Order {k} of customer {c}
import os
from base.order_{c} import settle_{c}

def settle_{k}(rate):
    if rate > {n} and rate < 90:
        return apply_{c}(rate)
    return os.environ.get("ORDER_{c}")

@app.get("/orders/{k}")
def view_{k}():
    token = "{h}"
    return settle_{k}(2)
"""),
    "2-HIGH": ("typescript", "web/y{y}/order_{k}.ts", """import {{ settle }} from './order_{c}';
// Loads order {k}
export async function load{k}(db) {{
  const rows = await prisma.orders{c}.findMany({{ where: {{ id: {k} }} }});
  if (rows.length > {n} || !rows) {{
    return process.env.ORDER_REGION;
  }}
  return settle(rows);
}}
class Order{k} {{
  total(x: number) {{
    return x > 1 ? x : load{k}(x);
  }}
}}
setInterval(load{k}, 5000);
"""),
    "3-MEDIUM": ("java", "app/y{y}/Order{k}Service.java", """package app.y{y};
import app.y{y}.Order{c}Service;
@Service
public class Order{k}Service {{
  private Order{c}Service next;
  @GetMapping("/orders/{k}")
  public BigDecimal net(BigDecimal gross) {{
    BigDecimal tax = gross.multiply(RATE);
    if (gross.compareTo(tax) > 0 && {n} > 10) {{
      return gross.subtract(tax);
    }}
    BigDecimal spare = tax.add(gross);
    return next.net(tax);
  }}
}}
"""),
    "4-NOT SPECIFIED": ("go", "cmd/y{y}/order_{k}.go", """package orders
import "shop/order_{c}"
func Serve{k}(mux Mux) {{
	mux.HandleFunc("/orders/{k}", view{c})
	for i := 0; i < {n}; i++ {{
		audit{c}(os.Getenv("ORDER_ZONE"))
	}}
}}
"""),
    "5-LOW": (None, "db/y{y}/order_{k}.sql", """CREATE TABLE IF NOT EXISTS orders_{k} (id int);
INSERT INTO orders_{k} SELECT * FROM orders_{c};
UPDATE orders_{c} SET id = {n};
"""),
}

# Values without a declared type: made, given back by calls, and copied on.
VALUE_TEMPLATES = {
    "2-HIGH": ("typescript", "vals/y{y}/box_{k}.ts", """export class Box{k} {{
  open(n: number) {{
    return n;
  }}
}}
export async function make{k}() {{
  const box = new Box{k}();
  return box;
}}
export async function take{k}(x) {{
  const got = await make{k}();
  got.open({n});
  const more = [x];
  return got;
}}
"""),
    "3-MEDIUM": ("java", "vals/y{y}/Flow{k}.java", """package vals.y{y};
public class Flow{k} {{
  public Flow{c} next(int x) {{
    return null;
  }}
  public int run(int x) {{
    var first = new Flow{c}();
    var second = first.next(x);
    var third = second;
    third.run({n});
    return x;
  }}
}}
"""),
}


def _fill(template: str):
    """Template text -> concat expression over the order columns."""
    import string

    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(F.col(name))
    return F.concat(*pieces)


def corpus(w: Warehouse, templates: dict[str, tuple] = TEMPLATES) -> DataFrame:
    """(path, lang, meta, size, text) of all orders whose priority has a template."""
    o = w.table("orders").select(
        "o_orderpriority",
        F.col("o_orderkey").cast("string").alias("k"),
        F.col("o_custkey").cast("string").alias("c"),
        F.year("o_orderdate").cast("string").alias("y"),
        (F.floor("o_totalprice").cast("long") % 50).cast("string").alias("n"),
        F.substring(F.sha1(F.col("o_orderkey").cast("string")), 1, 20).alias("h"),
    )
    path = lang = text = None
    for prio, (g, p, t) in templates.items():
        cond, lit = F.col("o_orderpriority") == prio, F.lit(g).cast("string")
        path = F.when(cond, _fill(p)) if path is None else path.when(cond, _fill(p))
        lang = F.when(cond, lit) if lang is None else lang.when(cond, lit)
        text = F.when(cond, _fill(t)) if text is None else text.when(cond, _fill(t))
    return o.filter(F.col("o_orderpriority").isin(list(templates))).select(path.alias("path"), lang.alias("lang"), F.lit(None).cast("string").alias("meta"), text.alias("text")).withColumn(
        "size", F.length("text").cast("long")
    )


# The facts the oracle starts from: keys, year, number and paths of every order.
ORDERS_SQL = """
o as (select o_orderpriority p, o_orderkey k, o_custkey c, year(o_orderdate) y, cast(floor(o_totalprice) as bigint) % 50 n,
             substr(sha1(cast(o_orderkey as varchar)),1,20) h,
             case o_orderpriority when '1-URGENT' then 'svc/y' || year(o_orderdate) || '/order_' || o_orderkey || '.py'
               when '2-HIGH' then 'web/y' || year(o_orderdate) || '/order_' || o_orderkey || '.ts'
               when '3-MEDIUM' then 'app/y' || year(o_orderdate) || '/Order' || o_orderkey || 'Service.java'
               when '4-NOT SPECIFIED' then 'cmd/y' || year(o_orderdate) || '/order_' || o_orderkey || '.go'
               else 'db/y' || year(o_orderdate) || '/order_' || o_orderkey || '.sql' end as path from orders)
"""
