from pyspark.sql import functions as F

from devicelogs.functions import parse as P

# Lines made for these tests. The alarm is delivered 900 ms of device time after its start (41,300 - 40,400); the alarms' clock shows
# 1,500,000,050,000 then and runs five hours (18,000,000 ms) ahead of the log, so the start is at 1,500,000,050,000 - 900 - 18,000,000.
INNER = r'{\"what\":\"TIMER\",\"type\":3,\"origWhen\":40100,\"wakeup\":false,\"tag\":\"sync\",\"flags\":8,\"uid\":1007,\"count\":2,\"when\":40200,\"windowLength\":65000,\"whenElapsed\":40400,\"maxWhenElapsed\":105400,\"repeatInterval\":70000,\"pid\":511,\"uuid\":\"aa-01\",\"whenRtc\":77,\"maxWhenRtc\":78,\"creatorPkg\":\"org.example.mail\",\"targetPkg\":\"org.example.sync\",\"appPid\":640}'
HEAD = "dev7\t1499982000500\t1499982000500.25\tboot-a\t1234\t98.75\t2017-07-13 21:40:00.500125   31   32 I "
ALARM = HEAD + 'Alarms {"func":"AlarmManagerService->deliverAlarmsLocked()","nowELAPSED":41300,"rtc":1500000050000,"alarm":"' + INNER + '"}'


def log(spark, *lines):
    return P.parse_loglines(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_header_and_rejects(spark):
    raw = spark.createDataFrame([(ALARM,), ("no header",), ("",), (None,)], "value string")
    (r,) = P.parse_loglines(raw).collect()
    assert (r.device_id, r.epoch_ms, r.epoch_ms_frac, r.boot_id, r.token, r.trace_time, r.pid, r.tid, r.level, r.tag) == ("dev7", 1499982000500, "1499982000500.25", "boot-a", 1234, 98.75, 31, 32, "I", "Alarms")
    assert r.ts_us == 1499982000_500125 and r.payload.startswith('{"func"') and r.line == ALARM
    assert P.rejected(raw).count() == 3


def test_alarm_fields_and_derived_times(spark):
    (r,) = P.extract_alarms(log(spark, ALARM)).collect()
    assert (r.alarm_type, r.orig_when, r.wakeup, r.flags, r.alarm_uid, r["count"], r.when_ms, r.window_length_ms, r.when_elapsed, r.max_when_elapsed, r.repeat_interval, r.alarm_pid, r.app_pid) == (3, 40100, False, 8, 1007, 2, 40200, 65000, 40400, 105400, 70000, 511, 640)
    assert (r.what, r.alarm_tag, r.uuid, r.creator_pkg, r.target_pkg, r.now_elapsed, r.rtc, r.json_when_rtc, r.json_max_when_rtc) == ("TIMER", "sync", "aa-01", "org.example.mail", "org.example.sync", 41300, 1500000050000, 77, 78)
    assert (r.when_rtc_ms, r.max_when_rtc_ms, r.late_us) == (1499982049100, 1499982114100, 900_000)
    assert P.extract_alarms(log(spark, HEAD + 'X {"func":"other","rtc":1}')).count() == 0


def test_screen_wakelock_and_battery(spark):
    (r,) = P.extract_screen(log(spark, HEAD + "Display: Set power mode=1, type=3 flinger=0xff10")).collect()
    assert (r.mode, r.type, r.addr) == (1, 3, 0xFF10)
    locks = P.extract_wakelocks(log(spark, HEAD + 'P {"func":"releaseWakeLockInternal","lock":41,"tag":"sync","flags":0,"pid":77}', HEAD + 'P {"func":"acquireWakeLockInternal","lock":42,"tag":"sync","flags":1,"pid":78,"uid":1008,"workSource":"me"}', HEAD + 'P {"func":"x","lock":1}', HEAD + "P text")).collect()
    assert sorted((r.lock, r.kind, r.uid, r.lock_pid) for r in locks) == [(1, "unknown", None, None), (41, "release", None, 77), (42, "acquire", 1008, 78)]
    (r,) = P.extract_battery(log(spark, HEAD + 'B {"BatteryProperties":{"ChargerAcOnline":false,"ChargerUsbOnline":true,"ChargerWirelessOnline":false}}')).collect()
    assert (r.ac, r.usb, r.wireless) == (False, True, False)


def test_trace_pm_and_healthd(spark):
    lines = log(spark, HEAD + "K thermal_temp: sensor_id=5 temp=63", HEAD + "K cpu_frequency: state=300000 cpu_id=1", HEAD + "K PM: suspend entry 2017", HEAD + "K PM: suspend exit", HEAD + "K healthd: battery l=5 chg= ", HEAD + "K healthd: battery l=5 chg=a", HEAD + "K thermal_temp: temp=x")
    assert sorted(r.temp for r in P.extract_trace(lines, "thermal_temp", {"temp": "int"}).collect() if r.temp is not None) == [63]
    (r,) = P.extract_trace(lines, "cpu_frequency", {"state": "int", "cpu_id": "int"}).collect()
    assert (r.state, r.cpu_id) == (300000, 1)
    (r,) = P.extract_trace(log(spark, HEAD + "K proc_foreground: pid=5 tgid=6"), "proc_foreground", {"pid": "int", "tgid": "int"}).collect()
    assert (r.pid, r.tgid, r.tid) == (5, 6, 32)
    assert sorted(r.pm for r in P.extract_pm(lines).collect()) == ["entry", "exit"]
    assert sorted(r.chg for r in P.extract_healthd(lines).collect()) == ["", "a"]
    assert P.extract_set_alarms(log(spark, HEAD + 'S {"func":"set","pid":1,"uid":2,"flags":0,"type":2,"triggerAtTime":5,"windowLength":7,"creatorPkg":"a"}')).select(F.sum("window_length_ms")).first()[0] == 7
