"""A small payroll code base in Java and TypeScript for the tracing tests."""

JAVA = {
    "src/com/acme/hrms/entity/Employee.java": """package com.acme.hrms.entity;
@Entity
@Table(name = "employees")
public class Employee {
  @Column(name = "monthly_salary")
  private BigDecimal monthlySalary;
  private BigDecimal auditPenalty;
  public BigDecimal getMonthlySalary() {
    return monthlySalary;
  }
}
""",
    "src/com/acme/hrms/entity/Payroll.java": """package com.acme.hrms.entity;
@Entity
@Table(name = "payroll")
public class Payroll {
  @Column(name = "gross_salary")
  private BigDecimal grossSalary;
  public void setGrossSalary(BigDecimal grossSalary) {
    this.grossSalary = grossSalary;
  }
}
""",
    "src/com/acme/hrms/dto/PayrollResponse.java": """package com.acme.hrms.dto;
public class PayrollResponse {
  private BigDecimal gross;
  public void setGross(BigDecimal gross) {
    this.gross = gross;
  }
}
""",
    "src/com/acme/hrms/service/PayrollService.java": """package com.acme.hrms.service;
public interface PayrollService {
  PayrollResponse generatePayroll(Employee employee, int days);
}
""",
    "src/com/acme/hrms/service/MonthlyPayrollService.java": """package com.acme.hrms.service;
import com.acme.hrms.entity.Employee;
import com.acme.hrms.entity.Payroll;
@Service
public class MonthlyPayrollService implements PayrollService {
  private PayrollRepository payrollRepository;
  public PayrollResponse generatePayroll(Employee employee, int days) {
    BigDecimal dailySalary = calculateDaily(employee);
    BigDecimal grossSalary = dailySalary.multiply(days);
    BigDecimal deductions = BigDecimal.ZERO;
    if (days < 20) {
      deductions = grossSalary.multiply(RATE);
    }
    BigDecimal netSalary = grossSalary.subtract(deductions);
    BigDecimal unusedTotal = grossSalary.add(deductions);
    Payroll payroll = new Payroll();
    payroll.setGrossSalary(grossSalary);
    payrollRepository.save(payroll);
    PayrollResponse response = new PayrollResponse();
    response.setGross(grossSalary);
    return response;
  }
  private BigDecimal calculateDaily(Employee employee) {
    BigDecimal monthlySalary = employee.getMonthlySalary();
    BigDecimal dailySalary = monthlySalary.divide(WORKING_DAYS);
    return dailySalary;
  }
}
""",
    "src/com/acme/hrms/service/PayrollPreviewService.java": """package com.acme.hrms.service;
@Service
public class PayrollPreviewService implements PayrollService {
  public PayrollResponse generatePayroll(Employee employee, int days) {
    BigDecimal total = employee.getMonthlySalary().multiply(days);
    PayrollResponse response = new PayrollResponse();
    response.setGross(total);
    return response;
  }
}
""",
    "src/com/acme/hrms/web/PayrollController.java": """package com.acme.hrms.web;
import com.acme.hrms.service.PayrollService;
@RestController
@RequestMapping("/api")
public class PayrollController {
  private PayrollService payrollService;
  @PostMapping("/payroll/{id}")
  public PayrollResponse run(Employee employee) {
    return payrollService.generatePayroll(employee, 30);
  }
}
""",
}
TS = {
    "src/lib/payroll.ts": """import { supabase } from './db';
const WORKING_DAYS = 30;
export async function loadEmployee(id: string) {
  const { data } = await supabase.from('employees').select('id, monthly_salary').eq('id', id);
  return data;
}
export function calculateDailySalary(employee: Employee) {
  const monthly = employee.monthlySalary;
  const daily = monthly / WORKING_DAYS;
  return daily;
}
export function payableDays(base: number, workedHours: number) {
  const payable = workedHours < HALF_DAY_THRESHOLD ? base - 0.5 : base;
  return payable;
}
export function calculateNetSalary(employee: Employee, tax: number, penaltyAmount: number) {
  const daily = calculateDailySalary(employee);
  const gross = daily * payableDays(22, 8);
  const deductions = tax + penaltyAmount;
  const net = gross - deductions;
  return net;
}
export async function generatePayroll(id: string) {
  const employee = await loadEmployee(id);
  const net = calculateNetSalary(employee, 10, 0);
  await supabase.from('payroll').insert({ net_salary: net, employee_id: id });
}
""",
    "src/ui/pay.tsx": """import { generatePayroll } from '../lib/payroll';
export function PayButton() {
  fetch('/api/payroll/:id', { method: 'POST' });
  fetch('/api/missing');
  return generatePayroll('1');
}
""",
}
