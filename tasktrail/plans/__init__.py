"""The reports: parameters in, one DataFrame with a fixed schema out."""

from tasktrail.plans.alerts import Alerts, attendance_alerts, evaluation_alerts
from tasktrail.plans.attendance import report_student_attendance
from tasktrail.plans.progress import (
    progress_report_benchmark,
    progress_report_benchmark_multidate,
    progress_report_individual,
    progress_report_individual_multidate,
)
from tasktrail.plans.report_card import report_card
from tasktrail.plans.task_detail import task_detail, task_detail_latest
from tasktrail.plans.task_summary import task_summary

__all__ = [
    "Alerts",
    "attendance_alerts",
    "evaluation_alerts",
    "progress_report_benchmark",
    "progress_report_benchmark_multidate",
    "progress_report_individual",
    "progress_report_individual_multidate",
    "report_card",
    "report_student_attendance",
    "task_detail",
    "task_detail_latest",
    "task_summary",
]
