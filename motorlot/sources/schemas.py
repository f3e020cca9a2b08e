"""Declared schemas: the stored tables of the driver data and the tables of the rental domain."""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = "struct<street:string,city:string,state_code:string,zip_code:string,country:string>"

STORED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

RENTAL_DOMAIN = {
    "locations": f"location_id long, location_name string, location_code string, address {ADDRESS}, phone string, "
                 "email string, operating_hours string, is_active string, created_at timestamp_ntz, "
                 "updated_at timestamp_ntz",
    "employees": "employee_id long, location_id long, first_name string, last_name string, email string, "
                 "phone string, hire_date date, job_title string, salary decimal(10,2), manager_id long, "
                 "is_active string, created_at timestamp_ntz",
    "customers": "customer_id long, first_name string, last_name string, email string, phones array<string>, "
                 f"address {ADDRESS}, license_number string, license_expiry date, date_of_birth date, "
                 "loyalty_points int, tier string, notes string, id_document binary, profile_xml string, "
                 "is_active string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "vehicle_categories": "category_id long, category_name string, description string, daily_rate decimal(8,2), "
                          "weekly_rate decimal(8,2), monthly_rate decimal(8,2), deposit_amount decimal(8,2)",
    "vehicles": "vehicle_id long, category_id long, location_id long, make string, model string, model_year int, "
                "color string, vin string, license_plate string, mileage long, fuel_type string, "
                "transmission string, seats int, status string, features array<string>, "
                "daily_override decimal(8,2), description string, last_service_date date, "
                "insurance_expiry date, is_active string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "reservations": "reservation_id long, customer_id long, vehicle_id long, pickup_location long, "
                    "dropoff_location long, pickup_date date, dropoff_date date, status string, "
                    "estimated_cost decimal(10,2), promo_code string, discount_pct decimal(5,2), employee_id long, "
                    "notes string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "rentals": "rental_id long, reservation_id long, customer_id long, vehicle_id long, pickup_location long, "
               "dropoff_location long, actual_pickup timestamp_ntz, actual_dropoff timestamp_ntz, "
               "odometer_out long, odometer_in long, fuel_level_out int, fuel_level_in int, "
               "base_charge decimal(10,2), fuel_charge decimal(8,2), damage_charge decimal(8,2), "
               "late_fee decimal(8,2), total_charge decimal(10,2), status string, employee_out long, "
               "employee_in long, damage_notes string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "payments": "payment_id long, rental_id long, customer_id long, payment_date timestamp_ntz, "
                "amount decimal(10,2), payment_method string, transaction_ref string, status string, "
                "currency_code string, exchange_rate decimal(10,6), notes string, created_at timestamp_ntz",
    "maintenance": "maintenance_id long, vehicle_id long, maintenance_type string, description string, "
                   "start_date date, end_date date, cost decimal(10,2), vendor string, technician_notes string, "
                   "status string, created_by long, created_at timestamp_ntz",
    "audit_log": "audit_id long, table_name string, operation string, record_id long, old_values string, "
                 "new_values string, changed_by string, changed_at timestamp_ntz",
    "promo_codes": "promo_code string, description string, discount_type string, discount_value decimal(8,2), "
                   "min_days int, max_uses int, current_uses int, valid_from date, valid_to date, is_active string",
}

REQUIREMENT = (
    "`@id` string, `@type` string, requirementId string, title string, description string, priority string, "
    "status string, technology array<string>, relatedEntity string, sqlOperation string, qualityAttribute string, "
    "dependsOn array<string>, inputFields array<struct<name:string,type:string,nullable:boolean>>"
)


def schema_of(table: str) -> T.StructType:
    """Schema of a stored or rental-domain table."""
    return T.StructType.fromDDL(STORED.get(table) or RENTAL_DOMAIN[table])
