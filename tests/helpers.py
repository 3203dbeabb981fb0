"""Builders for typed trace rows (nested tuples in schema order)."""

from schedlens import schemas as S


def struct(schema, **values):
    return tuple(values.get(f.name) for f in schema.fields)


def resources(cpus=None, memory=None):
    return struct(S.RESOURCES, cpus=cpus, memory=memory)


def task_info(job, idx, **kw):
    return struct(S.TASK_INFO, job=struct(S.JOB_INFO, id=job), task_index=idx, **kw)


def usage(start, end, job=42, idx=10, res=None, mx=None, req=None, machine=None, **kw):
    ti = task_info(job, idx, requested_resources=req, **kw)
    mi = struct(S.MACHINE_INFO, id=machine) if machine is not None else None
    return struct(S.TASK_USAGE, start_time=start, end_time=end, resources=res, max_resources=mx,
                  task_info=ti, machine_info=mi)


def event(time, type_, job=100, idx=99, missing=None, machine=None, **kw):
    mi = struct(S.MACHINE_INFO, id=machine) if machine is not None else None
    return struct(S.TASK_EVENT, time=time, missing_type=missing, type=type_,
                  info=task_info(job, idx, **kw), machine_info=mi)
