from basketflow.plans.session import STATE_SETTINGS, apply_settings

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_state_goes_to_rocksdb_unless_set_otherwise(spark):
    other = spark.newSession()
    for key in STATE_SETTINGS:
        other.conf.unset(key)
    assert apply_settings(other).conf.get(PROVIDER).endswith("RocksDBStateStoreProvider")
    other.conf.set(PROVIDER, "org.example.Other")
    assert apply_settings(other).conf.get(PROVIDER) == "org.example.Other"


def test_times_are_utc(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/Guayaquil")
    assert apply_settings(other).conf.get("spark.sql.session.timeZone") == "UTC"
