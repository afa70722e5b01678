"""Session settings that suit the library's plans."""

#: Long rule chains (units, motor sizes, keywords) make long methods. Above 8,000 bytes of code the JVM doesn't compile a
#: method; with this limit Spark leaves such a stage to its split, compiled expressions instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
