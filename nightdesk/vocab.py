"""Fixed values the operators share.

Everything in this module is a value that results depend on: event codes,
labels, patterns, thresholds and schedules.  No logic lives here.
"""

# --- event store names -------------------------------------------------------
SECURITY_INDEX = "wineventlog"
SECURITY_SOURCETYPE = "WinEventLog:Security"
SYSTEM_SOURCETYPE = "WinEventLog:System"
APPLICATION_SOURCETYPE = "WinEventLog:Application"
WEB_INDEX = "web"
ACCESS_SOURCETYPE = "nginx_access"
ERROR_SOURCETYPE = "nginx_error"
SYSLOG_SOURCETYPE = "syslog"
WEB_HOST = "web01"

# --- event codes -------------------------------------------------------------
LOGON = "4624"
LOGON_FAILED = "4625"
LOGON_EXPLICIT = "4648"
AUDIT_POLICY_CHANGED = "4719"
ACCOUNT_CREATED = "4720"
ACCOUNT_ENABLED = "4722"
PASSWORD_CHANGE = "4723"
PASSWORD_RESET = "4724"
ACCOUNT_DELETED = "4726"
GLOBAL_GROUP_ADD = "4728"
LOCAL_GROUP_ADD = "4732"
ACCOUNT_CHANGED = "4738"
LOCKED_OUT = "4740"
UNIVERSAL_GROUP_ADD = "4756"
UNLOCKED = "4767"
OBJECT_MODIFIED = "5136"
OBJECT_CREATED = "5137"
OBJECT_DELETED = "5141"
APP_CRASH = "1000"

GROUP_ADD_CODES = [GLOBAL_GROUP_ADD, LOCAL_GROUP_ADD, UNIVERSAL_GROUP_ADD]
OBJECT_CODES = [OBJECT_MODIFIED, OBJECT_CREATED, OBJECT_DELETED]
POLICY_CODES = OBJECT_CODES + [AUDIT_POLICY_CHANGED]
TIMELINE_CODES = [
    LOGON_FAILED, LOCKED_OUT, ACCOUNT_CREATED, PASSWORD_RESET,
    GLOBAL_GROUP_ADD, OBJECT_MODIFIED, AUDIT_POLICY_CHANGED, UNLOCKED,
]
LIFECYCLE_CODES = [
    ACCOUNT_CREATED, ACCOUNT_ENABLED, PASSWORD_CHANGE, PASSWORD_RESET,
    ACCOUNT_DELETED, ACCOUNT_CHANGED, UNLOCKED,
]

# --- labels by code ----------------------------------------------------------
LOGON_TYPES = {
    "2": "Interactive (local)",
    "3": "Network (SMB/RPC)",
    "4": "Batch",
    "5": "Service",
    "7": "Unlock",
    "8": "NetworkCleartext",
    "10": "RemoteInteractive (RDP)",
    "11": "CachedInteractive",
}
LOGON_TYPES_SHORT = {
    "2": "Interactive",
    "3": "Network",
    "4": "Batch",
    "5": "Service",
    "7": "Unlock",
    "10": "RemoteInteractive (RDP)",
    "11": "CachedInteractive",
}

STATUS_BAD_LOGON = "0xC000006D"
SUB_STATUS_WRONG_PASSWORD = "0xC000006A"
SUB_STATUS_UNKNOWN_USER = "0xC0000064"
FAILURE_STATUS = {
    "0xC0000234": "Account locked out",
    "0xC0000072": "Account disabled",
    "0xC000006F": "Outside allowed logon hours",
    "0xC0000070": "Workstation restriction",
    "0xC0000193": "Account expired",
}

GPO_CHANGE_TYPES = {
    OBJECT_MODIFIED: "GPO Modified",
    OBJECT_CREATED: "GPO Created",
    OBJECT_DELETED: "GPO Deleted",
}
# Three label sets for the same four codes; they differ on purpose.
POLICY_LABELS = {
    "file": {
        OBJECT_MODIFIED: "GPO Modified",
        OBJECT_CREATED: "GPO/Object Created",
        OBJECT_DELETED: "Object Deleted",
        AUDIT_POLICY_CHANGED: "Audit Policy Changed",
    },
    "panel": {
        OBJECT_MODIFIED: "Modified",
        OBJECT_CREATED: "Created",
        OBJECT_DELETED: "Deleted",
        AUDIT_POLICY_CHANGED: "Audit Policy",
    },
    "alert": {
        OBJECT_MODIFIED: "GPO Modified",
        OBJECT_CREATED: "GPO/Object Created",
        OBJECT_DELETED: "AD Object Deleted",
        AUDIT_POLICY_CHANGED: "Audit Policy Changed",
    },
}
LIFECYCLE_LABELS = {
    ACCOUNT_CREATED: "Account Created",
    ACCOUNT_ENABLED: "Account Enabled",
    PASSWORD_CHANGE: "Password Change Attempt",
    PASSWORD_RESET: "Password Reset (Admin)",
    ACCOUNT_DELETED: "Account DELETED",
    ACCOUNT_CHANGED: "Account Modified",
    UNLOCKED: "Account Unlocked",
}
# 4756 and 5137 never pass the base filter of the timeline; the labels are kept
# because they belong to the category table.
TIMELINE_LABELS = {
    "file": {
        LOGON_FAILED: "Failed Logon",
        LOCKED_OUT: "Account Lockout",
        ACCOUNT_CREATED: "User Created",
        PASSWORD_RESET: "Password Reset",
        GLOBAL_GROUP_ADD: "Group Membership Change",
        UNIVERSAL_GROUP_ADD: "Group Membership Change",
        OBJECT_MODIFIED: "GPO/AD Object Changed",
        OBJECT_CREATED: "GPO/AD Object Changed",
        AUDIT_POLICY_CHANGED: "Audit Policy Changed",
        UNLOCKED: "Account Unlocked",
    },
    "panel": {
        LOGON_FAILED: "Failed Logon",
        LOCKED_OUT: "Account Lockout",
        ACCOUNT_CREATED: "User Created",
        PASSWORD_RESET: "Password Reset",
        GLOBAL_GROUP_ADD: "Group Membership Change",
        OBJECT_MODIFIED: "GPO/AD Changed",
        OBJECT_CREATED: "GPO/AD Changed",
        AUDIT_POLICY_CHANGED: "Audit Policy Changed",
        UNLOCKED: "Account Unlocked",
    },
}

# --- patterns ----------------------------------------------------------------
PRIVILEGED_NAME = "(?i)(admin|svc|service|sa_|adm_)"
PRIVILEGED_NAME_ALERT = "(?i)(admin|svc|service|sa_|adm_|root)"
PRIVILEGED_GROUP = "(?i)(Domain Admin|Enterprise Admin|Schema Admin|Administrator|Backup Operator)"
EXPECTED_ACTOR = r"^(Administrator|SYSTEM|DC01\$)$"
EXPECTED_ACTOR_ALERT = r"(?i)^(SYSTEM|DC01\$|Administrator)$"
KNOWN_ADMIN = "(?i)(admin|jsmith|mchen)"
SERVER_SOURCE = "(?i)^(DC|SRV|SERVER)"
REMOVAL_WARNING_GROUP = "(?i)(Domain Admin|Enterprise Admin|IT.Admin|Admin)"
PROTECTED_ACCOUNT = "(?i)^(Administrator|admin)$"
OFFICE_SOURCE = "(?i)(Microsoft Office|Excel|WINWORD)"
ACCESS_LINE = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+\S+"\s+(\d+)\s+(\d+|-)'
    r'\s+"([^"]*)"\s+"([^"]*)"'
)
ACCESS_FIELDS = [
    "client_ip", "user", "timestamp", "method", "uri", "status", "bytes",
    "referrer", "user_agent",
]
STATUS_CLASSES = {
    500: "5xx - Server Error",
    400: "4xx - Client Error",
    300: "3xx - Redirect",
    200: "2xx - Success",
}

# --- flags -------------------------------------------------------------------
YES_FLAG = "YES ⚠"
YES_FLAG_PANEL = "⚠ YES"
HIGH_PRIVILEGE = "HIGH PRIVILEGE ⚠"
HIGH_PRIVILEGE_PANEL = "HIGH ⚠"

# --- thresholds --------------------------------------------------------------
RISK_BANDS = {20: "CRITICAL", 10: "HIGH", 5: "MEDIUM"}
KPI_BANDS = {
    "lockouts": [0, 3, 9],
    "failures": [0, 20, 99],
    "resets": [0, 10],
    "new_accounts": [0, 1],
    "changes": [0, 1],
    "http_errors": [0, 10],
}
LOCAL_ADDRESSES = ["-", "unknown", "127.0.0.1"]
LOCAL_ADDRESSES_PANEL = ["-", "unknown", "127.0.0.1", "::1"]
BUSINESS_HOURS = (7, 19)

# --- time text formats (Spark datetime patterns) -------------------------------
SECOND = "yyyy-MM-dd HH:mm:ss"
MINUTE = "yyyy-MM-dd HH:mm"
DAY = "yyyy-MM-dd"
CLOCK = "HH:mm:ss"
SHORT_MINUTE = "MM/dd HH:mm"
SHORT_SECOND = "MM/dd HH:mm:ss"
HOUR = "HH"
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"

# --- service desk --------------------------------------------------------------
LOG_LEVELS = ["INFO", "OK", "WARN", "ERROR", "ACTION"]
TICKET_SOURCES = {"web": "Web", "email": "Email", "phone": "Phone", "api": "API"}
DEPARTURE_REASONS = ["Resigned", "Terminated", "Transferred", "LeaveOfAbsence"]
DEFAULT_GROUP = "Domain Users"
DISABLED_OU = "OU=Disabled,DC=corp,DC=local"
RETENTION_DAYS = 90
TICKET_IP = "10.10.10.1"
# Lines of the offboarding report.
REPORT_FIELDS = {
    "Employee": "employee",
    "Username": "username",
    "Department": "department",
    "Title": "title",
    "Email": "mail",
    "Reason": "reason",
    "Offboarded By": "agent",
    "Ticket Number": "ticket",
}
FOLLOW_UP = [
    "Retrieve company equipment (laptop, badge, phone)",
    "Transfer/archive mailbox contents (Exchange admin)",
    "Revoke VPN certificate / pfSense user entry",
    "Remove from any non-AD systems (Jira, GitHub, Slack, etc.)",
    "Update org chart in HR system",
    "Forward voicemail / email to manager (if policy requires)",
]
SEVERITY = {3: "Medium", 4: "High"}

# --- display names for result tables -------------------------------------------
DISPLAY_NAMES = {
    "lockouts": {
        "lockout_time": "Lockout Time",
        "locked_account": "Locked Account",
        "locked_by_host": "Source Workstation",
        "dc_host": "Domain Controller",
    },
    "lockout_frequency": {
        "locked_account": "Account",
        "total_lockouts": "# Lockouts (7d)",
        "unique_sources": "# Source Hosts",
        "workstations": "Workstations",
        "first_lockout": "First Seen",
        "last_lockout": "Last Seen",
    },
    "brute_force": {
        "window_start": "10-Min Window",
        "risk": "Risk Level",
        "target_account": "Target Account",
        "failure_count": "Failures",
        "unique_ips": "# Source IPs",
        "source_ips": "Source IPs",
        "logon_types": "Logon Type(s)",
        "failure_reasons": "Failure Reason(s)",
    },
    "password_spray": {
        "source_ip": "Source IP",
        "accounts_targeted": "Accounts Targeted",
        "total_attempts": "Total Attempts",
        "spray_ratio": "Attempts/Account",
    },
    "gpo_changes": {
        "change_time": "Change Time",
        "change_type": "Change Type",
        "changed_by": "Modified By",
        "changed_by_domain": "Domain",
        "gpo_name": "GPO (DN)",
        "attribute": "Attribute Changed",
        "old_value": "Old Value",
        "new_value": "New Value",
        "dc_host": "DC",
    },
    "audit_policy_changes": {
        "change_time": "Time",
        "host": "DC",
        "changed_by": "Modified By",
        "policy_name": "Audit Policy Changed",
    },
    "unexpected_actors": {
        "actor": "Account",
        "changes": "# Changes",
        "last_seen": "Last Change",
    },
    "new_accounts": {
        "create_time": "Created At",
        "new_account": "New Account",
        "created_by": "Created By",
        "created_by_dom": "Domain",
        "is_privileged": "Privileged Name?",
        "dc_host": "DC",
    },
    "account_lifecycle": {
        "ev_time": "Time",
        "event_desc": "Event",
        "target": "Target Account",
        "actor": "Performed By",
        "host": "DC",
    },
    "high_privilege_group_adds": {
        "ev_time": "Time",
        "member_added": "User Added",
        "added_to_group": "Group",
        "is_high_priv": "Risk",
        "performed_by": "Added By",
        "host": "DC",
    },
    "top_locked_accounts": {"locked_account": "Account", "lockout_count": "Lockouts"},
    "failed_logons_by_ip": {
        "source_ip": "Source IP",
        "failures": "# Failures",
        "accounts_targeted": "Accounts Targeted",
    },
    "recent_lockouts": {
        "lockout_time": "Time",
        "locked_account": "Account",
        "source_workstation": "Workstation",
        "host": "DC",
    },
    "policy_changes": {
        "ev_time": "Time",
        "change_type": "Change",
        "actor": "By",
        "obj": "Object / Policy",
        "host": "DC",
    },
    "group_changes": {
        "ev_time": "Time",
        "member": "Member Added",
        "grp": "Group",
        "is_high_priv": "Risk",
        "actor": "Performed By",
        "host": "DC",
    },
    "brute_force_panel": {
        "window": "Window",
        "risk": "Risk",
        "target_account": "Account",
        "failures": "Failures",
        "source_ips": "Source IP(s)",
    },
    "lockouts_panel": {
        "lockout_time": "Time",
        "locked_account": "Account",
        "source_workstation": "From Workstation",
        "host": "DC",
    },
    "new_accounts_panel": {
        "create_time": "Created At",
        "new_account": "New Account",
        "created_by": "Created By",
        "is_privileged": "Priv Name?",
        "dc_host": "DC",
    },
    "ticket_report": {
        "number": "#",
        "subject": "Subject",
        "requester": "Requester",
        "agent": "Agent",
        "department": "Department",
        "status": "Status",
        "created": "Created",
    },
}
