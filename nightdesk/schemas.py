"""Fixed schemas.  Readers always pass one of these; nothing is inferred."""

from __future__ import annotations

WIN_EVENT = """
    _time timestamp, host string, index string, sourcetype string, EventCode string,
    Account_Name array<string>, Target_Account_Name array<string>,
    Subject_Account_Name array<string>, Subject_Account_Domain array<string>,
    Member_Account_Name array<string>, Caller_Computer_Name array<string>,
    Logon_Type string, Status string, Sub_Status string,
    IpAddress string, Source_Network_Address string, WorkstationName string,
    Object_Class string, Object_DN array<string>, LDAP_Display_Name string,
    Old_Value string, New_Value string, Policy_Change string
"""

WEB_ACCESS = """
    client_ip string, user string, timestamp string, method string, uri string,
    status string, bytes string, referrer string, user_agent string,
    _time timestamp, status_class string
"""

TICKET_REQUEST = """
    number string, subject string, user_email string, dept_name string, topic_name string,
    sla_name string, priority tinyint, status string, source string, created timestamp,
    agent_user string, body string, reply string
"""

TICKET = """
    ticket_id string, number string, user_id string, user_email_id string, status_id int,
    dept_id int, sla_id int, topic_id int, staff_id int, team_id int, source string,
    ip_address string, flags int, isoverdue int, created timestamp, updated timestamp,
    lastupdate timestamp, duedate timestamp, closed timestamp
"""
TICKET_CDATA = "ticket_id string, subject string"
THREAD = """
    thread_id string, object_id string, object_type string, extra string,
    lastmessage timestamp, lastresponse timestamp, created timestamp
"""
THREAD_ENTRY = """
    thread_id string, staff_id int, user_id string, type string, flags int, source string,
    format string, title string, body string, created timestamp, updated timestamp, poster string
"""
SLA = """
    id int, name string, grace_period int, flags int, notes string,
    created timestamp, updated timestamp
"""
DEPARTMENT = """
    id int, pid int, tpl_id int, sla_id int, name string, signature string, ispublic int,
    email_id int, autoresp_email_id int, flags int, created timestamp, updated timestamp
"""
HELP_TOPIC = """
    topic_id int, ispublic int, noautoresp int, topic_pid int, sla_id int, dept_id int,
    topic string, notes string, created timestamp, updated timestamp
"""
STAFF = """
    staff_id int, dept_id int, role_id int, username string, firstname string, lastname string,
    email string, phone string, phone_ext string, signature string, isadmin int, isactive int,
    isvisible int, onvacation int, assigned_only int, show_assigned_tickets int,
    max_page_size int, created timestamp, lastlogin timestamp, passwdreset timestamp,
    updated timestamp
"""
USER = """
    id string, org_id int, default_email_id string, status int, name string,
    created timestamp, updated timestamp
"""
USER_EMAIL = "id string, user_id string, flags int, address string"
TICKET_STATUS = "id int, name string"

TICKET_TABLES = {
    "ticket": TICKET,
    "ticket_cdata": TICKET_CDATA,
    "thread": THREAD,
    "thread_entry": THREAD_ENTRY,
    "sla": SLA,
    "department": DEPARTMENT,
    "help_topic": HELP_TOPIC,
    "staff": STAFF,
    "user": USER,
    "user_email": USER_EMAIL,
    "ticket_status": TICKET_STATUS,
}

AD_USER = """
    sam string, first string, last string, name string, dept string, ou string, title string,
    groups array<string>, phone string, mail string, manager string, enabled boolean,
    locked_out boolean, password_expired boolean, password_last_set timestamp,
    last_logon timestamp
"""
AD_GROUP = "name string, path string, desc string"
AD_OU = "name string, path string, desc string"
GPO = "name string, linked_to string, scope string"
MEMBERSHIP = "sam string, `group` string"

ADMIN_ACCOUNTS = "username string, is_admin string"
APP_EVENT = "time_generated timestamp, source string, event_id string, entry_type string, message string"
HOTFIX = "id string, description string, installed_on timestamp"
CRASH_FILE = "path string, length bigint, last_write timestamp"

TRIGGERED_ALERT = "alert string, severity int, key string, fired_at timestamp, subject string, message string"
