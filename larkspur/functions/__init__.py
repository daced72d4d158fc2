"""Part of larkspur: functions."""
