"""Job parameters and list settings.

Operators never read the environment: everything a job needs arrives in a
``Params`` value, so a run is reproducible from its arguments.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---- fixed values that must equal the reference's for the same results ----
# Root user name in a credential report, event filters of the sign-in check,
# device group watched by the uptime check, output key prefix of tracked
# resources and the three tracked resource types.
ROOT_USER = "<root_account>"
SIGNIN_EVENT_SOURCE = "signin.amazonaws.com"
SIGNIN_EVENT_TYPE = "AwsConsoleSignIn"
SIGNIN_SKIPPED_EVENT_NAME = "CheckMfa"
UPTIME_GROUP = "uptime-monitoring"
TRACKING_OUTPUT_PREFIX = "USAGETRACKING"
TYPE_CLOUDFRONT = "CloudFront"
TYPE_S3_ACCESS_LOGS = "S3AccessLogs"
TYPE_LOG_GROUP = "LogGroup"
BOOTSTRAP_STACK = "CDKToolkit"
# Stack states the drift check skips (any other state, including new ones, is checked).
IGNORED_STACK_STATES = [
    "ROLLBACK_COMPLETE", "ROLLBACK_FAILED", "ROLLBACK_IN_PROGRESS",
    "CREATE_IN_PROGRESS", "CREATE_FAILED",
    "DELETE_COMPLETE", "DELETE_FAILED", "DELETE_IN_PROGRESS",
]
# Upload and read link lifetimes of the temporary web storage.
PUT_URL_EXPIRES_SECONDS = 5 * 60
GET_URL_EXPIRES_SECONDS = 2 * 24 * 60 * 60
# ---------------------------------------------------------------------------


def split_setting(raw: str | None) -> list[str]:
    """Comma-separated setting -> list; absent or empty -> []."""
    if raw is None or raw == "":
        return []
    return raw.split(",")


def check_disjoint_countries(high_risk: list[str], home: list[str]) -> None:
    """Home and high-risk country lists must not overlap (F5); fail fast."""
    both = sorted(set(high_risk) & set(home))
    if both:
        raise ValueError(f"country codes in both the home and the high-risk list: {both}")


@dataclass(frozen=True)
class Params:
    """Everything a run depends on. ``now`` is an argument, never the clock."""

    now: dt.datetime = dt.datetime(2024, 1, 17, 0, 0, 0)
    days: int = 7
    high_risk_countries: list[str] = field(default_factory=list)
    home_countries: list[str] = field(default_factory=list)
    ip_ranges: list[str] = field(default_factory=list)
    accounts: list[str] | None = None
    max_credential_age: int = 90

    def __post_init__(self):
        check_disjoint_countries(self.high_risk_countries, self.home_countries)

    @property
    def window_end(self) -> dt.datetime:
        """Most recent UTC midnight (B1)."""
        return self.now.replace(hour=0, minute=0, second=0, microsecond=0)

    @property
    def window_start(self) -> dt.datetime:
        return self.window_end - dt.timedelta(days=self.days)
