"""Panel operators: functions from DataFrame to DataFrame."""
