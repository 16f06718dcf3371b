"""A small made-up project of two services, for golden queries and tests."""

ORDERS = "shop/src/main/java/org/acme/shop/controller/OrderController.java"
CLIENT = "shop/src/main/java/org/acme/shop/client/StockClient.java"
BASE = "shop/src/main/java/org/acme/shop/client/BaseClient.java"
STOCK = "stock/src/main/java/org/acme/stock/web/StockController.java"
ROUTES = "stock/src/main/java/org/acme/stock/Routes.java"
BROKEN = "stock/src/main/java/org/acme/stock/Broken.java"

SOURCES = {
    ORDERS: '''package org.acme.shop.controller;

import org.acme.shop.client.StockClient;
import org.web.bind.*;

@RequestMapping("/api/orders")
public class OrderController {
    private final StockClient client;

    /**
     * Places an order.
     */
    @PostMapping("/{shop}/place")
    public String place(String sku, int count) {
        client.reserve(sku, count);
        audit(() -> client.release(sku));
        return client.getName();
    }

    @RequestMapping(path = "list//{page}", method = RequestMethod.POST)
    java.util.List<String> list(int[] page) {
        String text = """
            no call: client.reserve()
            """;
        return null;
    }

    private void audit(Runnable task) {
        task.run();
    }
}
''',
    CLIENT: '''package org.acme.shop.client;

import org.springframework.web.client.RestTemplate;
import org.springframework.beans.factory.annotation.Value;

public class StockClient extends BaseClient {
    private RestTemplate rest;
    private final String baseUrl;
    @Value("${stock.prefix}")
    private String prefix;

    public StockClient(@Value("${stock.url:http://localhost:9}") String baseUrl) {
        this.baseUrl = baseUrl;
    }

    public boolean reserve(String sku, int count) {
        String url = baseUrl + prefix + "/items/" + sku;
        rest.put(url, null);
        log(sku).log(sku, count);
        return true;
    }

    public void release(String sku) {
        rest.exchange("http://stock:9/v1/items/" + find(sku), HttpMethod.DELETE, null);
        new Runnable() {
            public void run() {
                rest.delete("/v1/items/" + sku);
            }
        }.run();
    }

    String getName() { return "stock"; }
    String find(String sku) { return sku; }
    String find(Long id) { return null; }
}
''',
    BASE: '''package org.acme.shop.client;

abstract class BaseClient {
    protected <T extends Number> BaseClient log(T value) { return this; }
    protected BaseClient log(String text) { return this; }
    static BaseClient log(String text, int count) { return null; }
}
''',
    STOCK: '''package org.acme.stock.web;

@RequestMapping(value = "v1/items")
public interface StockController {
    @PutMapping("{sku}")
    void reserve(String sku);

    @DeleteMapping(path = "/{id}")
    void release(String id);

    @GetMapping
    Object[][] all(java.util.Map<String, int[]> filter);
}
''',
    ROUTES: '''package org.acme.stock;

class Routes {
    static final String ROOT = "/v2" + "/routes";

    void build(Router router, Unknown other) {
        router.get(ROOT + "/all", ctx -> {});
        router.route("/one/" + (1 + name));
        this.other().post("/never");
    }

    Thing other() { return null; }

    enum Kind { A, B }
}
''',
    BROKEN: '''package org.acme.stock;

class Broken {
    void open( {
''',
}

CONFIG = {
    "shop/src/main/resources/application.yml": "stock:\n  url: http://stock:8/v0\n  prefix: /v1\n  hosts:\n    - a\n    - name: b\n  on: true\n  none:\n",
    "shop/src/main/resources/application-prod.properties": "# production\nstock.prefix=/v1\nstock.url = ${scheme:https}://prod\nstock.key:x\n",
    "shop/config/bootstrap.yaml": "port: 80\n",
    "shop/src/main/resources/other.yml": "ignored: 1\n",
    "shop/src/main/resources/application-bad.yml": "a: [1\n",
}

SYMBOLS = [("lib.inner.Log", "write", ["java.lang.String"], "void")]

#: Types and one file of calls, for the choice of targets.
TYPES = {
    "C0": "package p; public class C0 { C0 foo() { return this; } public C0 own; protected C0 self; }",
    "C1": "package p; public class C1 extends C0 { }",
    "C2": "package p; public class C2 extends C1 { }",
    "C3": "package p; public class C3 extends C2 { }",
    "D": "package p; public class D extends C3 { }",
    "U": "package q; public class U { public static void util() { } public static final p.C0 K = null; }",
    "Box": "package p; public class Box<T> { T v; T get() { return v; } Box<T> next() { return this; } }",
    "Color": "package p; public enum Color { RED, GREEN; public void paint() { } }",
    "Outer": "package p; public class Outer { Inner make() { return null; } static class Inner { void deep() { } } }",
    "B": """package p; import static q.U.util; import q.U;
public class B extends C1 {
 void lng(long x) { } void obj(Object o) { } void obj(Integer i) { } void va(String... s) { } void over(C0 a) { } void over(C2 a) { } void bx(Integer i) { } void one(String s) { } void one(C0 s) { }
 void main(D d, B c, int i, B[] bs, Box<B> box) {
  d.foo();
  c.foo().foo().foo().foo().foo();
  util();
  c.va("a", "b");
  c.lng(i);
  c.obj(5);
  c.obj("s");
  bs[0].foo();
  self.foo();
  this.self.own.foo();
  c.over(new C3());
  c.over(new C1());
  c.bx(i);
  box.next().get().lng(3);
  Color.RED.paint();
  new Outer().make().deep();
  U.K.foo();
  c.nothing(); unknown.call(); c.one(null);
 }
}""",
}
