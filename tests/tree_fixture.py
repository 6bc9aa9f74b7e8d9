"""A mini source tree: entry point, service, model, view, test, config, import cycle, orphan, DDL, secret."""

FILES = {
    "src/main.py": "# Program entry\nfrom .service.orders import place\n\ndef main():\n    place(1)\n",
    "src/service/orders.py": "# Order service\nimport os\nfrom ..model.order import save_order\n\ndef place(n):\n    if n > 0 and n < 10:\n        save_order(n)\n    return os.environ.get('ORDER_KEY')\n",
    "src/model/order.py": "from ..service.orders import place\n\ndef save_order(n):\n    return Order.objects.create(n=n)  # models\n",
    "src/pages/cart.tsx": "import { total } from '../utils/sum';\nexport function Cart() {\n  return total(1, 2);\n}\n",
    "src/utils/sum.ts": "/** Adds. */\nexport function total(a: number, b: number) {\n  return a + b;\n}\nexport const twice = (x: number) => x * 2;\n",
    "src/utils/orphan.ts": "export function unusedHelper(x: number) {\n  return x;\n}\n",
    "tests/test_orders.py": "from src.service.orders import place\n\ndef test_place():\n    assert place(1)\n",
    "config/settings.yaml": "debug: true\n",
    "db/schema.sql": "CREATE TABLE IF NOT EXISTS orders (id int);\nINSERT INTO orders SELECT * FROM staging;\n",
    "app/keys.js": "const token = 'abcdefgh12345678';\napp.get('/orders', list);\n",
    "package.json": '{"name": "shop", "version": "1.0.0", "dependencies": {"express": "^4"}, "devDependencies": {"vitest": "1"}}\n',
    "requirements.txt": "# pins\nrequests>=2.0\nflask\n",
    "go.mod": "module shop\n\ngo 1.21\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
    "Dockerfile": "FROM scratch\n",
    "node_modules/x/index.js": "function skipped() {}\n",
    "logo.png": "not text",
}


def write(root):
    for path, text in FILES.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(root)
